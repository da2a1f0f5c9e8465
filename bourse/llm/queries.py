"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers

from . import audit, exact, language, lm, near, pages, personal, quality, tokens, trie, vectors
from .common import table

BYTE_BPE = "byte_bpe_50k.json"
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_personal_data(spark, sf_dir):
    return personal.find(table(spark, sf_dir, "documents"))


def op2_exact_copies(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    return tokens.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_RANKS))


def op4_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_copies(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "documents"))


def op6_binary_packing(spark, sf_dir):
    return tokens.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_near_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return tokens.length_report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_suffix_tree(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_main_text(spark, sf_dir):
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark, sf_dir):
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_exact_copies, op3_byte_bpe, op4_quality, op5_near_copies, op6_binary_packing, op7_near_vectors, op8_language, op9_token_counts, op10_suffix_tree, op11_prefix_trie, op12_main_text, op13_filter_audit)}

#: DuckDB twins where SQL can express the whole result.
ORACLES: dict[str, str] = {
    "op2_exact_copies": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
        g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM t)
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256 FROM g
    """,
    "op7_near_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
        r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.seen FROM r JOIN l ON l.x = r.node)
        SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.least, m.vec_id) AS component_id, coalesce(c.least, m.vec_id) = m.vec_id AS kept
        FROM embeddings m LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = m.vec_id
        LEFT JOIN (SELECT node, min(seen) AS least FROM r GROUP BY node) c ON c.node = m.vec_id
    """,
    "op11_prefix_trie": """
        WITH s AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        b AS (SELECT c, flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: list_transform(range(8), lambda j: (ascii(substr(c::VARCHAR, i, 1)) >> j::INTEGER) & 1)))::BIGINT[] AS bits FROM (SELECT DISTINCT c FROM s)),
        h AS (SELECT c, xor(list_reduce(bits, lambda a, x: xor(a >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295) % 6 AS h FROM b),
        r AS (SELECT h.c, s.place, s.role, s.text FROM h JOIN s ON s.c = h.c - h.c % 100 AND s.place <= h UNION ALL SELECT s.c, s.place + 10, role, text FROM h JOIN s ON s.c = h.c AND s.place > h),
        l AS (SELECT h.c, coalesce(any_value(q.seq), []) AS seq FROM h LEFT JOIN (SELECT c, list(sha256(length(role)::VARCHAR || ':' || role || text) ORDER BY place) AS seq FROM r GROUP BY c) q ON q.c = h.c GROUP BY h.c),
        z AS (SELECT c, list(length(text) ORDER BY place) AS chars FROM r GROUP BY c),
        m AS (SELECT l.c, len(seq) AS n, d, sha256(array_to_string(seq[1:d], ',')) AS node, sha256(array_to_string(seq[1:d - 1], ',')) AS up, coalesce(chars[d], 0) AS chars FROM l LEFT JOIN z ON z.c = l.c, unnest(range(len(seq) + 1)) AS t(d)),
        n AS (SELECT d, node, any_value(up) AS up, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY d, node),
        k AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
        u AS (SELECT m.c, n.d, (n.n_convs - 1) * n.chars AS saved, CASE WHEN k.node IS NULL THEN 1 ELSE 0 END AS leaf FROM n JOIN m ON m.c = n.conv_id AND m.d = n.d LEFT JOIN k ON k.d = n.d AND k.node = n.node),
        w AS (SELECT a.d, a.node, sum(u.saved) AS saved, sum(u.leaf) AS leaves FROM u JOIN m a ON a.c = u.c AND a.d <= u.d GROUP BY 1, 2)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, w.leaves::BIGINT AS n_leaves, w.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN w ON w.d = n.d AND w.node = n.node LEFT JOIN k ON k.d = n.d AND k.node = n.node LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.up
    """,
    "op13_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
        f AS (SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM t),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        w AS (SELECT part, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN fails[i] THEN 1 << (i - 1)::INTEGER ELSE 0 END))::INTEGER AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
        i AS (SELECT unnest(range(5))::INTEGER AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a JOIN i b ON b.i <> a.i JOIN i c ON c.i NOT IN (a.i, b.i) JOIN i d ON d.i NOT IN (a.i, b.i, c.i) JOIN i e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
        s AS (SELECT list_aggregate(list_transform(o, lambda x: chr(65 + x)), 'string_agg', '') AS filter_order, step::INTEGER AS step, o[step] AS f, coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0)::INTEGER AS before FROM o, unnest(range(1, 6)) AS q(step)),
        r AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE mask & (before | (1 << f)) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & (1 << f) > 0) AS removed, sum(n) FILTER (WHERE mask & before > 0 AND mask & (1 << f) > 0) AS redundant,
            sum(n) FILTER (WHERE mask = 1 << f) AS unique_fails, sum(good) FILTER (WHERE mask & before = 0 AND mask & (1 << f) > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & (1 << f) > 0) AS toxic_lost FROM w, s GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
            coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
    """,
}

"""Near duplicates by a chosen-path set similarity join on five-word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
#: Documents are linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Minwise tokens of a document's sketch, a byte each, and the multipliers that make two of them each.
COORDS, MULTIPLIERS = 128, 64
#: Independent trees. A pair at the threshold shares a tree's root token with 0.75; where nodes are small it is
#: missed with 0.25 ** TREES = 1e-6.
TREES = 10
#: Tokens that a node branches on; at any depth a pair at the threshold is missed with 0.34 ** TREES = 2e-5.
BRANCH = 2
#: Nodes up to this size are compared exhaustively on the sketches.
LEAF = 4096
#: Levels that a larger node branches; what is still larger then holds similar documents and is compared in pairs of blocks.
LEVELS = 4
#: Agreeing tokens from which a pair is a candidate; a pair at the threshold has fewer with a probability of 5e-6.
SKETCH = 75
#: Shingles and documents of a cluster that one task compares; larger clusters are compared in pairs of blocks.
CLUSTER_SHINGLES, CLUSTER_DOCS = 1_000_000, 3_000

_MASK = (1 << 64) - 1
_SEEDS = np.random.default_rng(20240229)
_SHIFT = _SEEDS.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORD = _SEEDS.integers(1, 1 << 63, MULTIPLIERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = _SEEDS.integers(1, 1 << 63, TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) > 400_000:
                self.clear()
            self[word] = value
        return value


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def windows(text: bytes) -> np.ndarray:
    """The shingles of a whole text, each as a 64-bit hash, as they follow one another.

    A-Z are lower-cased; words are separated by ASCII white space. With fewer than five words, the whole
    sequence is the one shingle; without words there is none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total += own[i : len(own) - k + 1 + i] * _SHIFT[i]
    return _mixed(total)


def numbered(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's set of shingles, numbered over all the texts: told apart by their words, not by hashes."""
    known, words, sizes = {b"": 0}, [], []
    for text in texts:
        own = [known.setdefault(w, len(known)) for w in text.lower().split()]
        if own:
            own += [0] * (WORDS - len(own))
            words.append(np.array(own, np.int64))
        sizes.append(max(0, len(own) - WORDS + 1))
    if not words:
        return [np.zeros(0, np.int64) for _ in texts]
    place = np.concatenate([w[: len(w) - WORDS + 1] for w in words])
    for i in range(1, WORDS):
        _, place = np.unique(place * len(known) + np.concatenate([w[i : len(w) - WORDS + 1 + i] for w in words]), return_inverse=True)
    ends = np.cumsum(sizes)
    return [np.unique(place[e - n : e]) for e, n in zip(ends, sizes)]


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's least in COORDS hash orders, a byte of each, and in TREES others, whole."""
    least, roots = np.full(2 * MULTIPLIERS, 0xFFFFFFFF, np.uint32), np.full(TREES, np.uint64(_MASK))
    for i in range(0, len(found), 2048):
        part = found[i : i + 2048, None]
        np.minimum(least, (part * _COORD).view(np.uint32).min(0), out=least)
        np.minimum(roots, (part * _ROOT).min(0), out=roots)
    return (_mixed(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8), _mixed(roots)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id; n (size of its set); digest (of the set); sketch; roots (the trees' root tokens).

    Shingles of unequal hashes differ; where some hashes of a text are equal, its shingles are counted by their words.
    """
    from hashlib import blake2b

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("roots", pa.list_(pa.int64()))])

    def rows(batch):
        out = ([], [], [], [])
        for text in batch.column(1).to_pylist():
            every = windows(text)
            found = np.unique(every)
            own, roots = sketch(found)
            out[0].append(len(found) if len(found) == len(every) else len(numbered([text])[0]))
            out[1].append(blake2b(found.tobytes(), digest_size=16).digest())
            out[2].append(own.tobytes())
            out[3].append(roots.view(np.int64))
        return [batch.column(0), *out]

    return docs.select(F.col("doc_id").cast("long"), common.text_binary().alias("body")).mapInArrow(common.batches(rows, schema), "doc_id long, n long, digest binary, sketch binary, roots array<long>")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), COORDS)


def _forest(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest by breadth-first search; ``near(i, left)`` says which of the unvisited are linked to i."""
    left, edges = np.arange(n), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            if hit.any():
                todo += left[hit].tolist()
                edges += [(i, j) for j in left[hit].tolist()]
                left = left[~hit]
    return edges


def leaf_edges(members: DataFrame) -> DataFrame:
    """A spanning forest of the candidate pairs in each node, every pair of it compared on the sketches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batch):
        out = ([], [])
        for ids, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(b"".join(packed), np.uint8).reshape(len(ids), COORDS)
            for i, j in _forest(len(ids), lambda i, left: (own[left] == own[i]).sum(1) >= SKETCH):
                out[0].append(ids[i])
                out[1].append(ids[j])
        return out

    groups = members.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("cid", "sketch"))).alias("m")).select(F.col("m.cid").alias("ids"), F.col("m.sketch").alias("sketches"))
    return groups.mapInArrow(common.batches(rows, schema), "a long, b long")


def branch(members: DataFrame) -> DataFrame:
    """Each member's children: one for each of the BRANCH tokens that its node selects."""
    schema = pa.schema([("node", pa.int64()), ("cid", pa.int64())])

    def rows(batch):
        node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        own, h = _matrix(batch.column(2)), _mixed(node + _MIX)
        start, step = (h % np.uint64(COORDS)).astype(np.int64), ((h >> np.uint64(8)) % np.uint64(COORDS)).astype(np.int64) | 1
        nodes = []
        for k in range(BRANCH):
            at = (start + k * step) % COORDS
            value = own[np.arange(len(own)), at].astype(np.uint64) + at.astype(np.uint64) * np.uint64(256)
            nodes.append(_mixed(_mixed(node * _SHIFT[0] + value * _SHIFT[1])).view(np.int64))
        return [np.concatenate(nodes), np.tile(batch.column(1).to_numpy(zero_copy_only=False), BRANCH)]

    return members.select("node", "cid", "sketch").mapInArrow(common.batches(rows, schema), "node long, cid long")


def block_pairs(members: DataFrame) -> DataFrame:
    """Large nodes as nodes of two blocks each, LEAF members about: every pair of members meets in one."""
    blocks = 2 * F.ceil(F.col("size") / LEAF)
    rows = members.withColumn("own", F.pmod(F.xxhash64("cid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "cid", "sketch")


def populated(front: DataFrame) -> DataFrame:
    """Members of the nodes with two or more, with the node's size."""
    sizes = common.materialise(front.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "nodes")
    return common.materialise(front.join(sizes, "node"), "members")


def linked_parts(ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each document the least id that its links lead to; all pairs are compared on their full sets of shingles, word by word."""
    own = numbered(texts)
    sizes = np.array([len(s) for s in own])
    mark = np.zeros(max(s.max(initial=0) for s in own) + 1, bool)

    def near(i, left):
        n = sizes[left]
        fits = (100 * np.minimum(n, sizes[i]) >= PERCENT * np.maximum(n, sizes[i])) & (n > 0)
        out = np.zeros(len(left), bool)
        if fits.any():
            mark[own[i]] = True
            at = left[fits]
            starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
            both = np.add.reduceat(mark[np.concatenate([own[j] for j in at])].astype(np.int64), starts)
            mark[own[i]] = False
            out[fits] = 100 * both >= PERCENT * (sizes[at] + sizes[i] - both)
        return out

    part = ids.copy()
    group = list(range(len(ids)))

    def top(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i, j in _forest(len(ids), near):
        group[top(j)] = top(i)
    root = np.array([top(x) for x in range(len(ids))])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, part)
    return least[root]


def _parts(rows: DataFrame, *keys: str) -> DataFrame:
    """(cid, component) of each group's documents."""

    def fn(table: pa.Table) -> pa.Table:
        ids = table.column("cid").to_numpy()
        return pa.table({"cid": ids, "component": linked_parts(ids, table.column("body").to_pylist())})

    return rows.select(*keys, "cid", "body").groupBy(*keys).applyInArrow(fn, "cid long, component long")


def resolve(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, component): the links within each cluster of candidates, on full sets; each text is sent once.

    A cluster above the bounds is dealt into blocks and compared in pairs of blocks, exactly as well.
    """
    weight = clusters.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("docs"))
    blocks = F.ceil(F.greatest(F.col("shingles") / CLUSTER_SHINGLES, F.col("docs") / CLUSTER_DOCS))
    weight = common.materialise(weight.select("cluster", blocks.alias("blocks")), "weights")
    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), common.text_binary().alias("body"))
    rows = texts.join(common.materialise(clusters.join(weight, "cluster").select("cid", "cluster", "blocks"), "clusters"), "cid")
    large = common.materialise(rows.filter("blocks > 1"), "large")
    small = _parts(rows.filter("blocks = 1"), "cluster")
    if large.isEmpty():
        return common.materialise(small, "parts")
    own = F.pmod(F.xxhash64("cid"), 2 * F.col("blocks"))
    other = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), 2 * F.col("blocks") - 1)))
    pairs = other.select("cid", "body", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    edges = common.materialise(_parts(pairs, "cluster", "i", "j").filter("cid <> component"), "edges")
    whole = components(edges, "cid", "component").select(F.col("node").alias("cid"), "component")
    return common.materialise(small.unionByName(whole), "parts")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one class, found by pre-aggregation, so copies make no pairs. The
    classes start in TREES trees by their root tokens; a node of more than LEAF branches by the minwise
    tokens that it selects, and a smaller one is compared exhaustively on the sketches. A node gives a
    spanning forest of its candidate pairs, one edge a member at most. The forests' components are the
    candidate clusters: each class is in one, so its text is sent once, and all pairs of a cluster that
    could still join two parts are compared on their full sets. A large group of near copies costs a
    search of its cluster, and a passage that many documents share makes no candidates. No node or cluster is
    capped: nodes still large after LEVELS of branching and large clusters are compared in pairs of blocks.

    Null and empty texts have an empty set and are linked with nothing. Rows that repeat a doc_id are
    placed each by its own text; a class bears the least doc_id of its rows, and one that two classes bear joins them. A row with a null doc_id gets a null component and isn't kept. No
    rows give no rows; columns other than doc_id and text are ignored.
    """
    since = common.mark()
    own = common.materialise(sketches(docs), "sketches")
    firsts = common.materialise(own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("cid")), "classes")
    members = common.materialise(own.select("doc_id", "n", "digest").join(firsts, "digest", "left").select("doc_id", "n", "cid"), "classed")
    rep = own.join(firsts.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("cid"))).dropDuplicates(["cid", "digest"]).select("cid", "n", "sketch", "roots")
    rep = common.materialise(rep, "representatives")
    found = populated(rep.select(F.explode(F.transform("roots", lambda x, i: F.xxhash64(i, x))).alias("node"), "cid"))
    edges = None
    for level in range(LEVELS + 1):
        at = found.join(rep.select("cid", "sketch"), "cid").select("node", "cid", "sketch", "size")
        small, large = at.filter(F.col("size") <= LEAF).drop("size"), at.filter(F.col("size") > LEAF)
        if level == LEVELS:
            small = small.unionByName(block_pairs(large))
        small = common.materialise(leaf_edges(small), "candidates")
        edges = small if edges is None else edges.unionByName(small)
        if level == LEVELS or found.filter(F.col("size") > LEAF).isEmpty():
            break
        found = populated(branch(large).distinct())
    clusters = components(edges).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    parts = resolve(clusters.join(rep.groupBy("cid").agg(F.sum("n").alias("n")), "cid"), docs).groupBy("cid").agg(F.min("component").alias("component"))
    out = members.join(parts, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "cid", "doc_id"))
    return common.sweep(since, out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the least doc_id (nulls last, of equal ones any), with the columns of ``docs``."""
    return common.one_of_each(docs, near_groups, "component_id", [F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id")], F.min)

"""The prefix trie of rebuilt conversations against brute force, on odd inputs."""

import hashlib
import random
import zlib

import pytest

from bourse.llm import common, queries, trie

DDL = "turn long, c long, conv_id long, text string, role string, k int"


def frame(spark, rows):
    """Turns as (conv_id, turn, role, text), with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(t, 7, c, x, r, 1) for c, t, r, x in rows], DDL)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    convs = {c: [(t[1], t[3]) for t in sorted(own)] for c, own in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(c - (abs(c) % 100) * (-1 if c < 0 else 1), [])[:h] + own[h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = kids.get(node, [])
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(sums[k][0] for k in own) or 1, saved + sum(sums[k][1] for k in own))
        stop = ",".join(map(str, sorted(c for c in members[node] if made[c] == node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(own), *sums[node], hashlib.sha256(stop.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def rows_of(rng, n, longest, alphabet):
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            out.append((c * rng.choice([1, 1, 3]), t, rng.choice(["user", "user", None]), "é" * rng.randrange(alphabet)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block, split", [(None, 1000), (1, 3), (3, 50)])
def test_trie(spark, monkeypatch, block, split):
    monkeypatch.setattr(common, "SPLIT", split)
    monkeypatch.setattr(trie, "SPAN", 2)
    monkeypatch.setattr(trie, "PIECE", 8)
    rng = random.Random(3)
    rows = rows_of(rng, 260, 9, 2) + [(900 + i, t, "user", f"t{t}") for i in range(40) for t in range(23)]  # copies of a longer one
    assert got(trie.prefix_trie(frame(spark, rows), block)) == brute(rows)


def test_trie_odd_inputs(spark):
    for rows in (
        [],
        [(None, 0, "user", "a")],
        [(7, 0, "user", "a")],  # turnless once its first turns are taken from a conversation that isn't there
        [(0, None, None, None), (0, 0, "", ""), (0, 0, "", ""), (1, 3, "a", "b"), (1, 3, "a", "c"), (1, 3, "b", "a"), (1, None, "x", ""), (None, 1, "u", "v")],
        [(-5, 0, "u", "x"), (-105, 0, "u", "x"), (-100, 1, "u", "x"), (2**62, 0, "u", "y" * 300_000)],
        [(200, t, "u", str(t % 2)) for t in range(400)] + [(201 + i, t, "u", str(t % 2)) for i in range(5) for t in range(30)],
    ):
        assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_trie_of_the_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in common.table(spark, sf_dir, "conversations").collect()]
    assert got(queries.op11_prefix_trie(spark, sf_dir)) == brute(rows)

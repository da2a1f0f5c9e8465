"""The filter audit against brute force over all orders, and on odd inputs."""

import itertools
import random
import re

import numpy as np
import pytest

from bourse.llm import audit, common, queries

DOCS, LABELS = "doc_id long, text string, source string, part string, label int, n int", "doc_id long, quality int, toxic int, x int"


def fails_of(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        })
    return out


def brute(docs, labels):
    fails, out, totals = fails_of(docs), {}, {}
    good, toxic = ({i for i, q, t in labels if v(q, t)} for v in (lambda q, t: q == 1, lambda q, t: t == 1))
    for part in {d[2] or "" for d in docs}:
        own = [(d, f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                totals[part, name] = totals.get((part, name), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[name] for _, f in own) - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in own),
                    sum(d[0] is not None and d[0] in good for d, _ in gone), sum(d[0] is not None and d[0] in toxic for d, _ in gone),
                ]
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, s, "x", 5, 1) for i, t, s in docs], DOCS), spark.createDataFrame([(*x, 1) for x in labels], LABELS)


@pytest.mark.parametrize("split", [1000, 4])
def test_audit(spark, monkeypatch, split):
    monkeypatch.setattr(common, "SPLIT", split)
    rng = random.Random(11)
    texts = [None, "", " \t\x0b", "A", "ÀÉ $", " ".join(f"w{i}" for i in range(60)), " ".join("same" for _ in range(80)), "x y " * 60, "#" + "Ab " * 70] + [" ".join(rng.choice("aBcD#é") + str(rng.randrange(40)) for _ in range(rng.randrange(30, 90))) for _ in range(40)]
    docs = [(rng.choice([None, rng.randrange(90)]) if rng.random() < 0.1 else i, rng.choice(texts), rng.choice(["a", "a", "b", "", None])) for i in range(400)] + [(3, "twice", "c"), (3, "twice", "c")]
    labels = [(rng.randrange(420), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    assert got(audit.interactions(*frames(spark, docs, labels))) == brute(docs, labels)


def test_audit_odd_inputs(spark):
    assert got(audit.interactions(*frames(spark, [], []))) == {}
    long = [(1, " ".join(f"w{i}" for i in range(300_000)), None)]
    assert got(audit.interactions(*frames(spark, long, []))) == brute(long, [])
    assert len(brute(long, [])) == 600


def test_audit_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in common.table(spark, sf_dir, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in common.table(spark, sf_dir, "labels").collect()]
    assert got(queries.op13_filter_audit(spark, sf_dir)) == brute(docs, labels)


def test_positional_counts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 100, 10_001):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]

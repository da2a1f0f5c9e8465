"""How filters interact: truth-table words of the subsets that a document survives, counted by carry-save popcounts."""

from __future__ import annotations

import itertools
import json
import math
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
SUBSETS, ALL = 1 << len(FILTERS), (1 << len(FILTERS)) - 1
#: WORDS[fails]: bit s is set if a document that fails the filters ``fails`` survives the subset s (both as bits, A lowest).
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & fails) for fails in range(SUBSETS)], np.uint32)
_UPPER, _MARKS = bytes(range(ord("A"), ord("Z") + 1)), re.compile(rb"[#$%&*|]")


def fails_alone(text: str) -> int:
    """The filters A to D that the text fails, as bits. ``bytes.split`` cuts at the six white spaces of ASCII."""
    raw = text.encode()
    found = raw.split()
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    return (len(found) < 50) + 2 * (100 * len(set(found)) < 65 * len(found)) + 4 * (100 * capitals > 5 * len(text)) + 8 * (_MARKS.search(raw) is not None)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set.

    Full adders take three words of one weight to one of that weight and one of twice the weight, all bits at once, until
    two words at most are left of each weight.
    """
    counts, weight, carried = np.zeros(32, np.int64), 1, words
    while len(carried):
        level, up = carried, []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            up.append(a & b | half & c)
            level = np.concatenate([half ^ c, level[3 * third :]])
        counts += weight * (level[:, None] >> np.arange(32, dtype=np.uint32) & 1).sum(0, dtype=np.int64)
        carried, weight = np.concatenate(up) if up else words[:0], 2 * weight
    return counts


def failures(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, part, fails (bits of A to E). Digests of the texts are shuffled, the texts stay in place."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("digest", pa.binary())])

    def rows(batch):
        texts = [t or "" for t in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), [fails_alone(t) for t in texts], [sha256(t.encode()).digest() for t in texts]]

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), "text")
    own = common.materialise(given.mapInArrow(common.batches(rows, schema), "doc_id long, part string, fails int, digest binary"), "fails")
    first = own.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = common.materialise(first.filter("last > first").drop("last"), "copied")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return common.join_groups(own, first, ["digest"], "size", "left").select("doc_id", "part", F.col("fails").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))


def survivors(failed: DataFrame) -> DataFrame:
    """Of each part and label (bit 0: quality, bit 1: toxic): the count of documents that survive each of the 32 subsets.

    A task counts the words of each batch by part and label; only these counts are shuffled.
    """
    schema = pa.schema([("part", pa.string()), ("label", pa.int32()), ("n", pa.list_(pa.int64()))])

    def rows(batch):
        parts = batch.column(0).dictionary_encode()
        group = parts.indices.to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy()
        order = np.argsort(group, kind="stable")
        words, group = WORDS[batch.column(2).to_numpy()[order]], group[order]
        keys, starts = np.unique(group, return_index=True)
        names = parts.dictionary.to_pylist()
        return [[names[k // 4] for k in keys], [k % 4 for k in keys], [positional_counts(w) for w in np.split(words, starts[1:])]]

    counts = failed.select("part", "label", "fails").mapInArrow(common.batches(rows, schema), "part string, label int, n array<long>")
    return counts.groupBy("part", "label").agg(F.array(*[F.sum(F.col("n")[s]) for s in range(SUBSETS)]).alias("n"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``label``; of a document with several labels, each is 1 if any says so."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((one("quality") + 2 * one("toxic")).alias("label")).filter("doc_id IS NOT NULL")
    return failed.join(marks, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def _steps() -> str:
    """Every step of every order: its filter and the subsets applied before and after it, as JSON."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"o": "".join(FILTERS[i] for i in order), "s": step, "f": f, "b": before, "a": before | 1 << f})
            before |= 1 << f
    return json.dumps(out)


def _shapley(n: Column, f: int) -> Column:
    """What filter f removes, summed over all orders: each subset before it comes in |s|! (4 - |s|)! of them."""
    total = F.lit(0).cast("long")
    for s in range(SUBSETS):
        if not s >> f & 1:
            k = s.bit_count()
            total = total + math.factorial(k) * math.factorial(len(FILTERS) - 1 - k) * (n[s] - n[s | 1 << f])
    return total


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source value), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Failure conditions of a whole text: A: under 50 words; B: distinct words under 65 % of words; C: capitals A-Z over 5 % of
    code points; D: one of #$%&*|; E: equal to the text of a smaller doc_id. A document becomes a word of 32 bits, one for
    each subset of the filters that it survives; every figure is a difference of the counts of these bits.

    A null text is empty (it fails A alone, and E if a smaller doc_id's text is empty), a null source is part "". Rows that
    repeat a doc_id count each and aren't copies of each other; a row without a doc_id is no copy, has none and has no
    label. A doc_id with several labels has each that any of them gives. No documents give no rows; other columns are ignored.

    Texts stay where they are read: 40 bytes a row are shuffled by digest and by doc_id, groups of equal texts are
    pre-aggregated in each task, and rows of a large group stay in place in the join back. A part costs a row a batch.
    """
    since = common.mark()
    by_label = survivors(labelled(failures(docs), labels))
    of = lambda bit: F.array(*[F.sum(F.when(F.col("label").bitwiseAND(bit) == bit, F.col("n")[s]).otherwise(0)) for s in range(SUBSETS)])
    sums = common.materialise(by_label.groupBy("part").agg(of(0).alias("n"), of(1).alias("good"), of(2).alias("toxic")), "survivors")
    steps = sums.withColumn("shapley", F.array(*[_shapley(F.col("n"), f) for f in range(len(FILTERS))])).withColumn("x", F.explode(F.from_json(F.lit(_steps()), "array<struct<o:string,s:int,f:int,b:int,a:int>>")))
    at = lambda column, place: F.get(column, place)
    lost = lambda column: at(column, F.col("x.b")) - at(column, F.col("x.a"))
    alone = F.lit(1)  # the subset of the filter alone
    for f in range(1, len(FILTERS)):
        alone = F.when(F.col("x.f") == f, 1 << f).otherwise(alone)
    out = steps.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), at("n", F.col("x.a")).alias("kept"), lost("n").alias("removed"), (at("n", F.lit(0)) - at("n", alone) - lost("n")).alias("redundant"),
        (at("n", ALL - alone) - at("n", F.lit(ALL))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shapley", F.col("x.f")).alias("shapley"),
    )
    return common.sweep(since, out)

"""Exact duplicates by most-significant-digit radix partitioning of the texts' bytes, over all machines."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the first digit; each next digit is GROWTH times wider, WIDEST at most.
FIRST, GROWTH, WIDEST = 64, 64, 1 << 20
#: Bits of the sieve that tells the rows whose first digit is surely their own: 16 MB, whatever the corpus.
SIEVE_BITS = 1 << 27


def _places(digits: list[bytes], ended: list[bool], n_bits: int) -> np.ndarray:
    return np.fromiter((crc32(d, e) % n_bits for d, e in zip(digits, ended)), np.int64, len(digits))


def prefixes(docs: DataFrame, width: int) -> DataFrame:
    """The first digit alone, and if the text ends in it: as many leading characters hold at least as many bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("ended", pa.bool_()), ("digit", pa.binary())])

    def rows(batch):
        return [batch.column(0), batch.column(1), pc.binary_slice(pc.ascii_lower(batch.column(2)).cast(pa.binary()), 0, width)]

    text = F.coalesce(F.col("text"), F.lit(""))
    start = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) <= width).alias("ended"), F.substring(text, 1, width).alias("text"))
    return start.mapInArrow(common.batches(rows, schema), "doc_id long, ended boolean, digit binary")


def sieve(shared: DataFrame):
    """The bits of the shared digits, as 64-bit words: 16 MB at most come to the driver and go to the tasks."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    n_bits = SIEVE_BITS

    def rows(batch):
        place = _places(batch.column(0).to_pylist(), batch.column(1).to_pylist(), n_bits)
        return [place >> 6, (np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64)]

    found = shared.select("digit", "ended").mapInArrow(common.batches(rows, schema), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out = np.zeros(n_bits >> 6, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return shared.sparkSession.sparkContext.broadcast(out)


def normalised(docs: DataFrame, width: int, bits) -> DataFrame:
    """doc_id; the SHA-256 of the text with A-Z lower-cased (null: no bytes), for the report; its bytes, null if its first digit is surely its own."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("body", pa.binary())])

    def rows(batch):
        low = pc.ascii_lower(batch.column(1)).cast(pa.binary()).to_pylist()
        place = _places([b[:width] for b in low], [len(b) <= width for b in low], 64 * len(bits.value))
        shared = (bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
        return [batch.column(0), [sha256(b).digest() for b in low], [b if keep else None for b, keep in zip(low, shared)]]

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(common.batches(rows, schema), "doc_id long, sha binary, body binary")


def digits(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumns({"digit": F.expr(f"substring(body, 1, {width})"), "ended": F.length("body") <= width})


def buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The digits that at least two rows share, each with a number of its own, the row count and the largest id."""
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("top")).filter("size > 1")
    return common.materialise(shared.withColumn("next_bucket", F.monotonically_increasing_id()), "radix")


def exact_groups(docs: DataFrame, first: int = FIRST, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The most
    significant digit is a text's first bytes, and if it ends in them; each round splits every bucket by the next
    bytes of its texts. A text that is alone in its bucket is done, and so is a bucket whose texts have
    ended; only the unread bytes of the others go to the next round. Equality is that of all bytes: the
    digest is a reported column and decides nothing.

    Only the first digits of all texts are shuffled. A sieve of fixed size then tells most texts whose first digit is
    their own where they are read; the others' bytes move. The rounds are exact whatever the sieve lets through.
    A bucket may hold a third of all rows: its size and largest id are pre-aggregated in every task, and
    the join back reads one row per bucket. The number of shared buckets grows with the input, so that
    join is a merge join at every size, whose hot buckets adaptive execution splits.

    Rows with a null doc_id count in their group but never stay unless all ids are null, where keep_id is
    null and kept false. Rows that repeat one doc_id and text all count and carry the same kept. No rows
    give no rows; other columns are ignored.
    """
    since = common.mark()
    width, keys = first, ["digit", "ended"]
    shared = buckets(prefixes(docs, width), keys)
    bits = sieve(shared)
    own = common.materialise(normalised(docs, width, bits), "normalised")
    done = [own.filter("body IS NULL").select("doc_id", F.col("doc_id").alias("top"), F.lit(1).cast("long").alias("size"), "sha")]
    active = own.filter("body IS NOT NULL")
    while True:
        found = digits(active, width).join(shared.hint("merge"), keys, "left")
        going = F.col("next_bucket").isNotNull() & ~F.col("ended")
        found = common.materialise(
            found.select(
                "doc_id", "sha", F.coalesce("size", F.lit(1)).alias("size"), F.when(F.col("next_bucket").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("top"),
                F.when(going, F.col("next_bucket")).alias("bucket"), F.when(going, F.expr(f"substring(body, {width + 1})")).alias("body"),
            ),
            "radix",
        )
        done.append(found.filter("bucket IS NULL").select("doc_id", "top", "size", "sha"))
        active = found.filter("bucket IS NOT NULL").select("doc_id", "sha", "bucket", "body")
        if active.isEmpty():
            break
        width, keys = min(width * growth, widest), ["bucket", "digit", "ended"]
        shared = buckets(digits(active, width), keys)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.select("doc_id", F.col("top").alias("keep_id"), F.col("size").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("top"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return common.sweep(since, out)


def drop_copies(docs: DataFrame) -> DataFrame:
    """Of the rows with equal texts the one with the largest doc_id (nulls last, of equal ones any), with the columns of ``docs``."""
    return common.one_of_each(docs, exact_groups, "keep_id", [F.col("doc_id").cast("long").alias("id")], F.max)

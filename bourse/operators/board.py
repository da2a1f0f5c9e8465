"""Market boards: movers, totals, ranks, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import staged


def gainers(board: DataFrame, k: int = 5) -> DataFrame:
    return board.filter("change > 0").orderBy(F.col("change").desc(), "ticker").limit(k)


def losers(board: DataFrame, k: int = 5) -> DataFrame:
    return board.filter("change < 0").orderBy("change", "ticker").limit(k)


def extremes(rows: DataFrame, by: str, tie: str, k: int = 5) -> DataFrame:
    """The k best and the k worst rows, whatever their sign."""
    best = rows.orderBy(F.col(by).desc(), tie).limit(k).withColumn("side", F.lit("top"))
    return best.unionByName(rows.orderBy(by, tie).limit(k).withColumn("side", F.lit("bottom")))


def level(total: Column) -> Column:
    return F.floor(total / 1000) + 1


def top_per_group(rows: DataFrame, key: str, by: str, tie: str, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col(by).desc(), tie))).filter(F.col("rank") <= k)


def ranked(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """1-based rank over all rows, the greatest first, missing values last, without one task that sorts them all.

    Rows are dealt by ranges of (by, tie) of about equal numbers, whatever the values' distribution, and staged in order;
    a row's rank is its place in its range after the rows of those before.
    """
    order = [F.col(by).desc_nulls_last(), F.col(tie).asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, "_range").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def only_friends(board: DataFrame, friends: DataFrame, key: str = "username") -> DataFrame:
    return board.join(friends, key, "left_semi")


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """1-based place of each row among those of its ``key``, in ``order``, by ranges of all rows: a key with many rows has many tasks."""
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumn("_range", F.shiftright("_at", 33)), "placed")
    runs = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(key, "_range", (before - F.col("_first") + 1).alias("_shift"))
    return dealt.join(runs, [key, "_range"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")

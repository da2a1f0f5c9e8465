"""Exact quantiles of groups of any size by histograms that are refined around the ranks asked for."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import discard, staged

#: Values of a group that one task may sort.
SMALL = 100_000
#: Bins of a histogram.
BINS = 32


def _narrowed(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """The values that may still be a target's, with the target's columns."""
    return rows.join(targets, key).filter((F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high"))))


def select_ranks(rows: DataFrame, targets: DataFrame, key: str, small: int, bins: int) -> DataFrame:
    """The value of each target's rank among its key's values: key, id, v. ``targets``: key, id, rank (from 0), low and high (null), n.

    A pass cuts the values between low and high into bins at approximate quantiles, which are sketches of fixed size, counts the
    bins exactly, and goes on with the bin that has the rank, until it holds one value or few enough to sort.
    """
    done, targets = [], staged(targets, "targets")
    while not targets.isEmpty():
        few = targets.filter(F.col("n") <= small)
        done.append(staged(_narrowed(rows, few, key).groupBy(key, "id", "rank").agg(F.sort_array(F.collect_list("v")).alias("s")).select(key, "id", F.get("s", F.col("rank").cast("int")).alias("v")), "selected"))
        many = targets.filter(F.col("n") > small)
        cut = [i / bins for i in range(1, bins)]
        edges = staged(_narrowed(rows, many, key).groupBy(key, "id").agg(F.array_distinct(F.approx_percentile("v", cut, 1000)).alias("edges")), "edges")
        # a bin holds the values above an edge and below the next one, or an edge's own
        place = F.size(F.filter("edges", lambda e: e < F.col("v"))) + F.size(F.filter("edges", lambda e: e <= F.col("v")))
        counts = _narrowed(rows, many, key).join(edges, [key, "id"]).groupBy(key, "id", "rank", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(key, "id").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("before", before).filter("before <= rank AND rank < before + n")
        next_ = staged(hit.select(key, "id", (F.col("rank") - F.col("before")).alias("rank"), "low", "high", "n"), "targets")
        done.append(next_.filter("low = high").select(key, "id", F.col("low").alias("v")))
        discard(targets)
        discard(edges)
        targets = next_.filter("low < high")
    out = done[0] if done else rows.sparkSession.createDataFrame([], f"{key} string, id int, v double")
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def percentiles(rows: DataFrame, key: str, value: str, shares: list[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """The continuous percentiles of ``value`` for each ``key``, exactly those of ``percentile``: key, n, p (one for each of ``shares``).

    Groups of up to ``small`` values are sorted in one task each; in larger ones, fewer than a ``small``-th of the rows, the values at
    the ranks below and above each share are selected over several passes, so that no task holds a group's values. Null values
    and keys are left out. The values are staged, so that what makes them, and what it broadcasts, runs once and not in each pass.
    """
    rows = staged(rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v")), "values")
    sizes = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "sizes")
    light = rows.join(sizes.filter(F.col("n") <= small), key).groupBy(key).agg(F.first("n").alias("n"), F.percentile("v", shares).alias("p"))
    heavy = sizes.filter(F.col("n") > small)
    if heavy.isEmpty():
        return light
    at = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    ranks = F.array(*[x for s in shares for x in (F.floor(at(s)), F.ceil(at(s)))])
    targets = heavy.select(key, "n", F.posexplode(ranks).alias("id", "rank")).select(key, "id", "rank", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n")
    found = select_ranks(rows, targets, key, small, bins).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", "v"))).alias("m"))

    def between(i: int, share: float):
        low, high, place = F.col("m")[2 * i], F.col("m")[2 * i + 1], at(share)
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return light.unionByName(heavy.join(found, key).select(key, "n", F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("p")))


def expected_shortfall(rows: DataFrame, key: str, value: str, confidence: float, small: int = SMALL) -> DataFrame:
    """Mean of the values up to the exact percentile of 1 - ``confidence``: key, var, es."""
    cut = percentiles(rows, key, value, [round(1 - confidence, 12)], small).select(key, F.col("p")[0].alias("var"))
    return rows.join(cut, key).filter(F.col(value) <= F.col("var")).groupBy(key, "var").agg(F.avg(value).alias("es"))

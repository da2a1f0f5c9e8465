"""Covariances of many return series by products of blocks of tickers and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Tickers in a block and days in a span of dates, about: a product takes two blocks over one span (8 MB each at most).
WIDTH, DAYS = 256, 2048


def _products(pair, rows):
    """The sums of each pair of tickers of two blocks, over the dates that both have in the span: six matrix products."""
    import numpy as np
    import pandas as pd

    names = np.array(sorted(rows["ticker"].unique()), object)
    line, column = pd.Categorical(rows["ticker"], names).codes, pd.factorize(rows["date"])[0]
    x = np.zeros((len(names), column.max() + 1))
    known = np.zeros_like(x)
    x[line, column], known[line, column] = rows["x"], 1.0
    block = np.zeros(len(names), np.int64)
    block[line] = rows["block"]
    i, j = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    sums = {
        "n": known[i] @ known[j].T, "sx": x[i] @ known[j].T, "sy": known[i] @ x[j].T, "sxx": (x[i] ** 2) @ known[j].T, "syy": known[i] @ (x[j] ** 2).T, "sxy": x[i] @ x[j].T,
    }
    at, to = np.nonzero((sums["n"] > 0) & ((i[:, None] <= j[None, :]) | (pair[0] != pair[1])))
    out = {"a": names[i[at]], "b": names[j[to]]} | {k: v[at, to] for k, v in sums.items()}
    swapped = out["a"] > out["b"]
    for u, v in (("a", "b"), ("sx", "sy"), ("sxx", "syy")):
        out[u], out[v] = np.where(swapped, out[v], out[u]), np.where(swapped, out[u], out[v])
    return pd.DataFrame(out)[["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"]]


def upper(returns: DataFrame, width: int = WIDTH, days: int = DAYS) -> DataFrame:
    """Sample covariance and correlation of each unordered pair of tickers over their common dates: a, b (a <= b), cov, corr, n.

    Tickers are dealt into blocks by hash and dates into spans; a row goes to as many pairs of blocks as there are blocks, and a
    pair's span to one task, which returns a row for each pair of tickers: what is shuffled grows with blocks times dates, not
    with pairs of tickers times dates. Returns are less their ticker's mean, so nothing cancels. A date that one of the two
    lacks counts for neither; below two common dates cov and corr are null. A (ticker, date) should have one return. The
    returns are staged once, as they are read for the means and for the products.
    """
    rows = staged(returns.filter("ticker IS NOT NULL AND date IS NOT NULL AND ret IS NOT NULL").select("ticker", "date", "ret"), "returns")
    mean = rows.groupBy("ticker").agg(F.avg("ret").alias("_mean"))
    blocks = max(1, -(-mean.count() // width))
    rows = rows.join(mean, "ticker").select("ticker", "date", (F.col("ret") - F.col("_mean")).alias("x"), F.pmod(F.xxhash64("ticker"), F.lit(blocks)).alias("block"), F.floor(F.unix_date(F.to_date("date")) / days).alias("span"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    parts = rows.groupBy("i", "j", "span").applyInPandas(_products, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cross = F.col("sxy") - sx * sy / n
    spread = F.sqrt(F.greatest(F.col("sxx") - sx * sx / n, F.lit(0.0)) * F.greatest(F.col("syy") - sy * sy / n, F.lit(0.0)))
    return sums.select("a", "b", F.when(n > 1, cross / (n - 1)).alias("cov"), F.when(n > 1, F.try_divide(cross, F.nullif(spread, F.lit(0.0)))).alias("corr"), n.cast("long").alias("n"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both orders of each pair."""
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.withColumn("e", F.explode(ends)).select("e.a", "e.b", *[c for c in pairs.columns if c not in ("a", "b")])

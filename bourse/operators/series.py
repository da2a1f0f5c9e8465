"""Bars and ordered series: construction, statistics, moving windows, returns, gap fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import RowRangeError
from ..functions.numeric import fix


def ohlcv(trades: DataFrame, keys: list[str], seq: str, price: str = "price", qty: str = "qty") -> DataFrame:
    """One bar per key: open and close by ``seq``, high, low, volume, volume-weighted price, trade count.

    One partial aggregation and one shuffle on the keys. Zero volume gives a null vw.
    """
    p, q = F.col(price), F.col(qty)
    return trades.groupBy(*keys).agg(
        F.min_by(p, seq).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, seq).alias("close"),
        F.sum(q).cast("long").alias("volume"), fix(F.try_divide(F.sum(p * q), F.sum(q)), 4).alias("vw"), F.count(F.lit(1)).alias("n"),
    )


def bucket_start(ts: str, multiplier: int, span: str) -> Column:
    """Start of the bar that ``ts`` falls in; weeks start on Monday, months take no multiplier but 1."""
    if span in ("week", "month"):
        if multiplier != 1:
            raise ValueError(f"a multiplier of {multiplier} isn't defined for {span}")
        return F.date_trunc(span, ts)
    return F.window(ts, f"{multiplier} {span}")["start"]


def rebar(bars: DataFrame, multiplier: int, span: str) -> DataFrame:
    """Coarser bars from daily ones."""
    start = F.to_date(bucket_start("date", multiplier, span)) if span in ("week", "month") else F.col("date")
    rows = bars.withColumn("start", start)
    return rows.groupBy("ticker", "start").agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.sum("n").alias("n"))


def stats(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Mean, greatest, least and population deviation of close levels; below two rows the deviation is 0."""
    c = F.col("close")
    return bars.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("avg_close"), F.max(c).alias("max_close"), F.min(c).alias("min_close"), F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.stddev_pop(c)).alias("volatility"))


def last_average(bars: DataFrame, period: int, key: str = "ticker") -> DataFrame:
    """Mean of the last ``period`` closes; 0 if there are fewer or the period isn't positive."""
    w = W.partitionBy(key).orderBy(F.col("date").desc())
    rows = bars.withColumn("r", F.row_number().over(w))
    return rows.groupBy(key).agg(F.when((F.max("r") >= period) & F.lit(period > 0), F.avg(F.when(F.col("r") <= period, F.col("close")))).otherwise(0.0).alias("ma"))


def rows_at(bars: DataFrame, asks: DataFrame, key: str = "ticker") -> DataFrame:
    """The bar at each asked index (from 0, by date) of its ticker: the columns of ``asks`` (key, index), the bar's, and
    ``in_range``; out of range the bar's are null."""
    place = (F.row_number().over(W.partitionBy(key).orderBy("date")) - 1).cast("long")
    rows = bars.withColumns({"index": place, "in_range": F.lit(True)})
    return asks.join(rows, [key, "index"], "left").withColumn("in_range", F.coalesce("in_range", F.lit(False)))


def row_at(bars: DataFrame, ticker: str, index: int):
    """One ticker's bar at an index; an index out of range is an error."""
    own = bars.filter(F.col("ticker") == ticker)
    found = own.orderBy("date").offset(index).limit(1).collect() if index >= 0 else []
    if not found:
        raise RowRangeError(f"{ticker} has no row {index}")
    return found[0]


def moving_average(bars: DataFrame, period: int, key: str = "ticker", out: str = "ma") -> DataFrame:
    """Sliding mean over ``period`` rows; null until there are so many."""
    w = W.partitionBy(key).orderBy("date").rowsBetween(1 - period, 0)
    return bars.withColumn(out, F.when(F.count("close").over(w) == period, F.avg("close").over(w)))


def lagged(bars: DataFrame, key: str = "ticker", steps: int = 1) -> Column:
    return F.lag("close", steps).over(W.partitionBy(key).orderBy("date"))


def previous_close(bars: DataFrame) -> DataFrame:
    return bars.withColumn("prev_close", lagged(bars))


def pct_change(bars: DataFrame) -> DataFrame:
    prev = F.col("prev_close")
    return previous_close(bars).withColumn("change", 100 * F.try_divide(F.col("close") - prev, prev))


def snapshot(bars: DataFrame) -> DataFrame:
    """Latest bar of each ticker, with the close before it and the change in percent."""
    w = W.partitionBy("ticker").orderBy(F.col("date").desc())
    rows = previous_close(bars).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return rows.withColumn("change", fix(100 * F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close")), 4))


def returns(bars: DataFrame, key: str = "ticker", log: bool = False) -> DataFrame:
    ratio = F.try_divide(F.col("close"), lagged(bars, key))
    return bars.withColumn("ret", F.ln(ratio) if log else ratio - 1)


def last_rows(bars: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    return bars.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.col("date").desc()))).filter(F.col("r") <= n)


def candle(bars: DataFrame) -> DataFrame:
    o, c, h, low = (F.col(x) for x in ("open", "close", "high", "low"))
    return bars.withColumns({"colour": F.when(c >= o, "up").otherwise("down"), "body": F.abs(c - o), "wick": h - low, "body_mid": (o + c) / 2, "wick_mid": (h + low) / 2})


def last_by(rows: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """The last row's columns of each key: a partial aggregation, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def drawdown(curve: DataFrame, key: str = "ticker", value: str = "value") -> DataFrame:
    top = F.max(value).over(W.partitionBy(key).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return curve.withColumn("drawdown", F.col(value) / top - 1)


def equity(rets: DataFrame, key: str = "ticker", ret: str = "ret", start: float = 1.0) -> DataFrame:
    """Compounded value after each return."""
    total = F.sum(F.log1p(F.col(ret))).over(W.partitionBy(key).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return rets.withColumn("value", start * F.exp(total))


def random_walk(spark, n: int = 50, start: float = 100.0, seed: int = 7) -> DataFrame:
    """Synthetic candles: each opens at the close before it and moves by U(-5, 15), padded by U(0, 20)."""
    rows = spark.range(n).select("id", (F.rand(seed) * 20 - 5).alias("move"), (F.rand(seed + 1) * 20).alias("up"), (F.rand(seed + 2) * 20).alias("down"))
    close = start + F.sum("move").over(W.orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("close", close).withColumn("open", F.col("close") - F.col("move"))
    return rows.select("id", "open", (F.greatest("open", "close") + F.col("up")).alias("high"), (F.least("open", "close") - F.col("down")).alias("low"), "close")


def walks_from(latest: DataFrame, n: int = 50, seed: int = 7) -> DataFrame:
    """Synthetic candles of each ticker that go on from its latest close, as in ``random_walk``: ticker, id, open, high, low, close."""
    rows = latest.select("ticker", F.col("close").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("id"))
    rows = rows.select("*", (F.rand(seed) * 20 - 5).alias("move"), (F.rand(seed + 1) * 20).alias("up"), (F.rand(seed + 2) * 20).alias("down"))
    close = F.col("start") + F.sum("move").over(W.partitionBy("ticker").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("close", close).withColumn("open", F.col("close") - F.col("move"))
    return rows.select("ticker", "id", "open", (F.greatest("open", "close") + F.col("up")).alias("high"), (F.least("open", "close") - F.col("down")).alias("low"), "close")

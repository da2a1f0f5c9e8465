"""Queries that run a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fix
from ..operators import series
from ..sources import views
from ..streaming import ticks as S
from .flow import _VWAP, BBO
from .registry import query


class _Streamed:
    """Stands for a session whose tables are read as streams."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def read(self):
        return self

    def parquet(self, path):
        return S.source(self.spark, self.sf_dir, path.rsplit("/", 1)[1].removesuffix(".parquet"))


@query("""SELECT ticker, date_trunc('day', ts) AS start, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2""")
def stream_tumbling_bars(spark, sf_dir):
    return S.drain(_ticks(spark, sf_dir), S.tumbling_bars, at_once=True).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT ticker, date_trunc('week', ts) AS start, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2""")
def stream_weekly_bars(spark, sf_dir):
    return S.drain(_ticks(spark, sf_dir), lambda rows: S.tumbling_bars(rows, "7 days"), at_once=True).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT ticker, CAST(date_trunc('month', ts) AS DATE) AS start, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2""")
def stream_monthly_bars(spark, sf_dir):
    """The streamed bars of days put together by calendar month."""
    days = S.drain(_ticks(spark, sf_dir), S.tumbling_bars, at_once=True)
    return series.rebar(days.withColumn("date", F.to_date("start")).drop("start"), 1, "month").select("ticker", "start", "open", "high", "low", "close", "volume", "n")


@query(
    """WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts, seq) AS session FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY ticker ORDER BY ts, seq) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ticks))
    SELECT ticker, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n FROM s GROUP BY ticker, session"""
)
def stream_session_bars(spark, sf_dir):
    rows = S.drain(_ticks(spark, sf_dir), S.session_bars, at_once=True)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


def _ticks(spark, sf_dir):
    return views.ticks(_Streamed(spark, sf_dir), sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query(_VWAP % ("ticks", 3599))
def stream_rolling_vwap(spark, sf_dir):
    return S.drain(_ticks(spark, sf_dir), lambda rows: S.rolling_vwap(rows, 3600), at_once=True).withColumn("vwap", fix(F.col("vwap"), 4))


@query(BBO)
def stream_bbo(spark, sf_dir):
    return S.drain(views.quotes(_Streamed(spark, sf_dir), sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), S.best_quotes)


@query("SELECT order_id, ts, seq, prev_ts FROM (SELECT *, lag(ts) OVER (PARTITION BY order_id ORDER BY ts, seq) AS prev_ts FROM order_events) WHERE ts - prev_ts <= 86400")
def stream_duplicates(spark, sf_dir):
    orders = _ticks(spark, sf_dir).select("ts", F.col("trader").alias("order_id"), "seq")
    return S.drain(orders, lambda rows: S.duplicate_orders(rows.withColumn("ts", F.unix_seconds("ts")), 86_400), at_once=True)

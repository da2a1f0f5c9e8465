"""Queries over order flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fix
from ..operators import orderflow
from ..sources import views
from .registry import query, sql_fix

_VWAP = f"""WITH p AS (SELECT *, floor(price * 10000 + 0.5) * qty AS pq FROM %s),
    s AS (SELECT ticker, seq, sum(pq) OVER r - coalesce(sum(pq) OVER l, 0) AS num, sum(qty) OVER r - coalesce(sum(qty) OVER l, 0) AS den FROM p
    WINDOW r AS (PARTITION BY ticker ORDER BY sec RANGE BETWEEN %d PRECEDING AND CURRENT ROW), l AS (PARTITION BY ticker, sec ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT ticker, seq, CASE WHEN den = 0 THEN 0.0 ELSE {sql_fix("num / den / 10000", 4)} END AS vwap FROM s"""


@query(_VWAP % ("ticks", 3599))
def rolling_vwap(spark, sf_dir):
    return orderflow.rolling_vwap(views.ticks(spark, sf_dir), 3600).select("ticker", "seq", fix(F.col("vwap"), 4).alias("vwap"))


@query((_VWAP % ("(SELECT *, (date - DATE '1970-01-01') AS sec, seq AS own FROM trades)", 29)).replace("SELECT ticker, seq, sum(pq)", "SELECT *, sum(pq)").replace("SELECT ticker, seq, CASE", "SELECT ticker, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE"))
def rolling_vwap_ties(spark, sf_dir):
    rows = views.trades(spark, sf_dir).withColumn("sec", F.unix_date("date").cast("long"))
    out = orderflow.rolling_vwap(rows, 30)
    return out.select("ticker", *[F.col(f"seq.{c}").alias(c) for c in views.LINE], fix(F.col("vwap"), 4).alias("vwap"))


@query(
    f"""SELECT ticker, seq, {sql_fix("sum(floor(price * 10000 + 0.5) * qty) OVER w / nullif(sum(qty) OVER w, 0) / 10000", 4)} AS vwap FROM ticks
    WINDOW w AS (PARTITION BY ticker ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)"""
)
def rolling_vwap_continuous(spark, sf_dir):
    return orderflow.rolling_vwap_continuous(views.ticks(spark, sf_dir), 3600).select("ticker", "seq", fix(F.col("vwap"), 4).alias("vwap"))


@query("SELECT ts, order_id, seq, prev_ts FROM (SELECT *, lag(ts) OVER (PARTITION BY order_id ORDER BY ts, seq) AS prev_ts FROM order_events) WHERE ts - prev_ts <= 86400")
def duplicate_orders(spark, sf_dir):
    return orderflow.duplicate_orders(views.order_events(spark, sf_dir), 86_400)


@query(
    """SELECT symbol, target, arg_min(price, level) FILTER (WHERE total >= target) AS crossing_price FROM (SELECT *, sum(size) OVER (PARTITION BY symbol ORDER BY level) AS total FROM ladder) GROUP BY symbol, target"""
)
def crossing_level(spark, sf_dir):
    return orderflow.crossing_level(views.ladder(spark, sf_dir))


@query("SELECT p.parent_id, p.qty, CAST(coalesce(c.n, 0) AS BIGINT) AS child_qty, p.qty = coalesce(c.n, 0) AS matched FROM parents p LEFT JOIN (SELECT parent_id, sum(qty) AS n FROM children GROUP BY 1) c USING (parent_id)")
def parent_child_match(spark, sf_dir):
    return orderflow.match_children(views.parents(spark, sf_dir), views.children(spark, sf_dir))


BBO = """WITH lives AS (SELECT * FROM (SELECT *, lead(seq) OVER (PARTITION BY symbol, side, price ORDER BY seq) AS until FROM quotes) WHERE action = 'upsert' AND size > 0)
    SELECT q.symbol, q.seq, max(l.price) FILTER (WHERE l.side = 'B') AS best_bid, min(l.price) FILTER (WHERE l.side = 'A') AS best_ask FROM quotes q
    LEFT JOIN lives l ON l.symbol = q.symbol AND l.seq <= q.seq AND (l.until IS NULL OR l.until > q.seq) GROUP BY 1, 2"""


@query(BBO)
def best_bid_offer(spark, sf_dir):
    return orderflow.best_quotes(views.quotes(spark, sf_dir))


@query(BBO)
def best_bid_offer_interval(spark, sf_dir):
    return orderflow.best_quotes_by_interval(views.quotes(spark, sf_dir))


@query(
    """SELECT l_orderkey AS symbol, CAST(sum(qty) AS BIGINT) AS total, arg_min(price, k) FILTER (WHERE run >= 60) AS crossing_price FROM (SELECT *, sum(qty) OVER w AS run, row_number() OVER w AS k FROM trades
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1"""
)
def crossing_level_arrays(spark, sf_dir):
    """Ladders that arrive as arrays: those of an order's lines, a few each."""
    rows = views.trades(spark, sf_dir).groupBy(F.col("seq.l_orderkey").alias("symbol")).agg(F.sort_array(F.collect_list(F.struct("seq", "price", "qty"))).alias("l"))
    prices, sizes = F.transform("l", lambda x: x["price"]), F.transform("l", lambda x: x["qty"])
    return rows.select("symbol", F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), orderflow.crossing_in_arrays(prices, sizes, F.lit(60)).alias("crossing_price"))

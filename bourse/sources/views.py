"""The canonical views of market data over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price() -> Column:
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5) / 100


def trades(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_quantity").cast("long").alias("qty"), _price().alias("price"), F.to_date("l_shipdate").alias("date"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("ticker", "date", "price", "qty", F.struct(*LINE).alias("seq"))


def bars(spark, sf_dir) -> DataFrame:
    return series.ohlcv(trades(spark, sf_dir), ["ticker", "date"], "seq")


def months(spark, sf_dir) -> DataFrame:
    rows = trades(spark, sf_dir).withColumns({"seq": F.struct("date", "seq"), "date": F.trunc("date", "month")})
    return series.ohlcv(rows, ["ticker", "date"], "seq")


def returns(spark, sf_dir) -> DataFrame:
    return series.returns(months(spark, sf_dir)).select("ticker", "date", "ret").filter("ret IS NOT NULL")


def stock_bars(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), _price().alias("price"), F.to_date("l_shipdate").alias("date"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("ticker"), F.col("p_name").alias("stock_name"), F.col("p_type").alias("sector"))
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("s_suppkey", F.col("r_name").alias("exchange"))
    rows = lines.join(part, F.col("l_partkey") == F.col("id")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("id", "ticker", "date", "stock_name", "exchange", "sector").agg(F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.sum("qty").alias("volume"))


def ticks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("ticker"), F.col("ts"), _seconds().alias("sec"), F.col("value").alias("price"), _k().alias("qty"), F.col("event_id").alias("seq"), F.col("user_id").alias("trader"))


def _seconds() -> Column:
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def quotes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 50).alias("symbol"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"),
        F.when(F.col("event_id") % 2 == 0, "B").otherwise("A").alias("side"), (F.floor(F.col("value") / 5) * 5.0).alias("price"), _k().alias("size"), "ts",
    )


def order_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(_seconds().alias("ts"), F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"))


def parents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent_id"), (F.col("o_orderkey") % 8).alias("qty"))


def children(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.lit(1).cast("long").alias("qty"))


def ladder(spark, sf_dir) -> DataFrame:
    from ..operators import board

    p = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_partkey", "p_size")
    p = board.placed(p, "p_brand", "p_retailprice", "p_partkey")
    return p.select(F.col("p_brand").alias("symbol"), F.col("place").alias("level"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("long").alias("size"), (F.substring("p_brand", 7, 9).cast("long") * 20).alias("target"))


def contracts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("underlying"), (F.col("p_partkey") % 2 == 0).alias("is_call"), F.col("p_retailprice").alias("strike"), (F.col("p_size") + 7).alias("expiry_days"),
        ((F.col("p_size") + 7) / 365.0).alias("years"), F.lit(950.0).alias("spot"), F.lit(0.01).alias("rate"), (0.1 + (F.col("p_partkey") % 40) / 100.0).alias("vol"),
    )


def symbols(spark, sf_dir) -> DataFrame:
    p, two = table(spark, sf_dir, "part"), lambda n: F.lpad((n + 1).cast("string"), 2, "0")
    option = F.concat(
        F.lit("O:"), F.upper(F.substring("p_type", 1, 4)), F.lit("25"), two(F.col("p_size") % 12), two(F.col("p_size") % 28), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P"),
        F.lpad(F.floor(F.col("p_retailprice") * 1000 + 0.5).cast("string"), 8, "0"),
    )
    kind = F.col("p_partkey") % 5
    return p.select(F.col("p_partkey").alias("id"), F.when(kind == 0, option).when(kind == 1, "X:BTCUSD").when(kind == 2, "C:EURUSD").when(kind == 3, "I:SPX").otherwise(F.col("p_brand")).alias("symbol"))


def transactions(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_quantity", F.to_date("l_shipdate").alias("date"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("portfolio_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("portfolio_id", "ticker", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("transaction_type"), F.col("l_quantity").cast("long").alias("quantity"), _price().alias("price"), "date", F.struct(*LINE).alias("seq"))


def holdings(spark, sf_dir) -> DataFrame:
    from ..operators import portfolio

    return portfolio.holdings_of(transactions(spark, sf_dir))


def portfolios(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("portfolio_id"), F.col("c_name").alias("username"), F.col("c_acctbal").alias("balance"))


def latest(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


def board(spark, sf_dir) -> DataFrame:
    return series.snapshot(bars(spark, sf_dir)).select("ticker", F.col("close").alias("price"), "change")

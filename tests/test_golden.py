import math

import pytest
from pyspark.sql import functions as F

from bourse.errors import AssetNotFoundError, InvalidAssetTypeError, RequestError, RowRangeError
from bourse.functions import numeric as N
from bourse.functions import symbols as S
from bourse.operators import backtest, board, orderflow, portfolio, series, surface
from bourse.sources import files, store


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def bars(spark, closes, ticker="A"):
    rows = [(ticker, f"2024-01-{i + 1:02d}", float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date string, close double").withColumn("date", F.to_date("date"))


def test_series_stats(spark):
    five = bars(spark, [10, 12, 11, 15, 14])
    r = series.stats(five).first()
    assert (r.avg_close, r.max_close, r.min_close) == (12.4, 15, 10)
    assert r.volatility == pytest.approx(1.854724, abs=1e-6)
    assert series.last_average(five, 3).first().ma == pytest.approx(13.333333, abs=1e-6)
    assert [series.last_average(five, n).first().ma for n in (0, 6)] == [0.0, 0.0]
    one = series.stats(bars(spark, [10])).first()
    assert (one.avg_close, one.volatility) == (10, 0.0)
    assert series.stats(five.limit(0)).count() == 0


def test_row_access(spark):
    five = bars(spark, [10, 12, 11, 15, 14])
    assert [series.row_at(five, "A", i).close for i in (0, 4)] == [10, 14]
    for ticker, i in (("A", 5), ("A", -1), ("B", 0)):
        with pytest.raises(RowRangeError):
            series.row_at(five, ticker, i)


def test_scans_are_in_order(spark):
    rows = bars(spark, [3, 1, 2]).unionByName(bars(spark, [9], "B")).unionByName(spark.createDataFrame([("C", None, 7.0)], "ticker string, date date, close double"))
    got = [(r.ticker, r.close) for r in store.scan({"t": rows}, "t", store.Scan()).collect()]
    assert got == [("C", 7.0), ("A", 3.0), ("B", 9.0), ("A", 1.0), ("A", 2.0)]
    assert [r.close for r in store.scan({"t": rows}, "t", store.Scan(ascending=False, offset=1, limit=2)).collect()] == [1.0, 3.0]
    assert [r.ticker for r in board.gainers(spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", -1.0), ("w", 3.0)], "ticker string, change double")).collect()] == ["w", "y", "x"]


def test_rolling_vwap(spark):
    rows = spark.createDataFrame([("A", 0, 10.0, 100, 0), ("A", 1, 11.0, 50, 1), ("A", 1, 12.0, 50, 2), ("A", 3, 9.0, 200, 3), ("A", 10, 10.0, 0, 4)], "ticker string, sec long, price double, qty long, seq long")
    for chunk in (1, 5, 86_400):
        assert column(orderflow.rolling_vwap(rows, 3, chunk=chunk), "vwap", "seq") == pytest.approx([10.0, 10.333333, 10.75, 9.833333, 0.0], abs=1e-6)


def test_duplicate_orders(spark):
    rows = spark.createDataFrame([(0, "A", 0), (1, "B", 1), (5, "A", 2), (6, "A", 3), (20, "B", 4)], "ts long, order_id string, seq long")
    assert column(orderflow.duplicate_orders(rows, 5), "ts", "seq") == [5, 6]


@pytest.mark.parametrize(("target", "price"), [(0, 10.0), (100, 10.0), (101, 10.1), (600, 10.2), (601, None)])
def test_crossing_level(spark, target, price):
    rows = spark.createDataFrame([("A", i, p, s, target) for i, (p, s) in enumerate([(10.0, 100), (10.1, 200), (10.2, 300)])], "symbol string, level int, price double, size long, target long")
    assert orderflow.crossing_level(rows).first().crossing_price == price
    arrays = spark.createDataFrame([([10.0, 10.1, 10.2], [100.0, 200.0, 300.0])], "p array<double>, s array<double>")
    assert arrays.select(orderflow.crossing_in_arrays(F.col("p"), F.col("s"), F.lit(target)).alias("x")).first().x == price


QUOTES = [("upsert", "B", 99.0, 10), ("upsert", "A", 101.0, 5), ("upsert", "B", 100.0, 7), ("delete", "B", 100.0, 0), ("upsert", "A", 100.5, 3), ("upsert", "A", 100.5, 0), ("upsert", "B", 98.0, 1)]
BEST = [(99.0, None), (99.0, 101.0), (100.0, 101.0), (99.0, 101.0), (99.0, 100.5), (99.0, 101.0), (99.0, 101.0)]


@pytest.mark.parametrize("method", [orderflow.best_quotes, orderflow.best_quotes_by_interval])
def test_best_quotes(spark, method):
    rows = spark.createDataFrame([(1, i, *q) for i, q in enumerate(QUOTES)], "symbol long, seq long, action string, side string, price double, size long")
    assert [(r.best_bid, r.best_ask) for r in method(rows).orderBy("seq").collect()] == BEST


def test_parents(spark):
    p = spark.createDataFrame([("P1", 10), ("P2", 5), ("P3", 0)], "parent_id string, qty long")
    c = spark.createDataFrame([("P1", 4), ("P1", 6), ("P2", 4), ("P9", 1)], "parent_id string, qty long")
    assert column(orderflow.match_children(p, c), "matched", "parent_id") == [True, False, True]


@pytest.mark.parametrize(("s", "k", "t", "v", "call", "put", "dc", "dp"), [(100, 100, 1, 0.2, 8.433319, 7.438302, 0.559618, -0.440382), (100, 110, 0.5, 0.3, 4.906633, 14.358006, 0.374613, -0.625387), (178.2, 150, 30 / 365, 0.25, 28.353670, 0.030433, 0.992875, -0.007125)])
def test_black_scholes(spark, s, k, t, v, call, put, dc, dp):
    c = [F.lit(float(x)) for x in (s, k, t, 0.01, v)]
    yes, no = F.lit(True), F.lit(False)
    price = N.black_scholes(yes, *c)
    r = spark.range(1).select(price.alias("c"), N.black_scholes(no, *c).alias("p"), N.delta(yes, *c).alias("dc"), N.delta(no, *c).alias("dp"), N.implied_vol(yes, *c[:4], price).alias("iv")).first()
    assert (r.c, r.p, r.dc, r.dp) == pytest.approx((call, put, dc, dp), abs=1e-6)
    assert r.iv == pytest.approx(v, abs=1e-6)
    assert r.c - r.p == pytest.approx(s - k * math.exp(-0.01 * t), abs=1e-9)


def test_norm_cdf(spark):
    xs = [x / 4 for x in range(-28, 29)]
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", N.norm_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 2e-15 for r in got)


def test_symbols(spark):
    rows = spark.createDataFrame([("O:AAPL250117C00150000",), ("X:BTCUSD",), ("C:EURUSD",), ("I:SPX",), ("AAPL",)], "s string")
    got = rows.select(S.asset_class(F.col("s")).alias("k"), *[c.alias(n) for n, c in S.occ_parts(F.col("s")).items()]).collect()
    assert [r.k for r in got] == ["Option", "Crypto", "Forex", "Index", "Stock"]
    assert (got[0].underlying, str(got[0].expiry), got[0].option_type, got[0].strike) == ("AAPL", "2025-01-17", "call", 150.0)
    assert got[4].expiry is None
    texts = spark.createDataFrame([("$1,500",), ("+2.5%",), ("$1.2M",), ("n/a",)], "t string").select(S.money(F.col("t")).alias("m"))
    assert [r.m for r in texts.collect()] == [1500.0, 2.5, 1_200_000.0, None]
    assert spark.range(1).select(S.epoch_day(F.lit(86400 * 366 - 1)).alias("d")).first().d == "1971-01-01"


def test_limits(spark):
    assert [store.page_limit(x) for x in (None, "abc", "0", "9999", "50")] == [100, 100, 1, 5000, 50]
    got = spark.createDataFrame([(None,), ("abc",), ("0",), ("9999",), ("50",)], "t string").select(S.clamped_limit(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == [100, 100, 1, 5000, 50]


def test_bags(spark):
    ddl = "asset_type string, asset_name string"
    a, b = spark.createDataFrame([("Stock", x) for x in "aab"], ddl), spark.createDataFrame([("Stock", x) for x in "ac"], ddl)
    assert column(portfolio.difference(a, b), "asset_name", "asset_name") == ["a", "b"]
    assert column(portfolio.difference(portfolio.union(a, b), b), "asset_name", "asset_name") == ["a", "a", "b"]
    assert portfolio.remove_asset(a, "Stock", "a").count() == 2
    with pytest.raises(AssetNotFoundError):
        portfolio.remove_asset(a, "Stock", "z")
    with pytest.raises(InvalidAssetTypeError):
        portfolio.remove_asset(a, "Bond", "a")
    assert portfolio.add_asset(a, {"asset_type": "Forex", "asset_name": "e"}).filter("asset_type = 'FX'").count() == 1


def test_levels_and_ranks(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 999.99, 1000.0, 4550.0])], "id int, v double")
    assert column(rows.withColumn("l", board.level(F.col("v"))), "l", "id") == [1, 1, 2, 5]
    assert column(board.ranked(rows, "v", "id"), "rank", "id") == [4, 3, 2, 1]


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ticker,date,open,close,high,low,volume\nAAPL,2024-01-02,1,2,3,0.5,5e+06\nAAPL,2024-01-02,1,2,3,0.5,5e+06\n")
    assert files.read_legacy_csv(spark, str(tmp_path), dedup=False).count() == 2
    assert [r.volume for r in files.read_legacy_csv(spark, str(tmp_path)).collect()] == [5_000_000]


def test_csv_edges(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0, 1.0, 2**40, None), (2, "A", None, 1.0, 1.0, 1.0, 1, "2024-01-01")], "id long, ticker string, open_price double, close_price double, high_price double, low_price double, volume long, date string").withColumn("date", F.to_date("date"))
    files.write_csv(rows, path)
    assert sorted(map(str, files.read_csv(spark, path, "asset_data").collect())) == sorted(map(str, rows.collect()))
    good, bad = files.quarantine(spark.createDataFrame([("a", "2024-01-01"), ("a", "x"), (None, "2024-01-01")], "ticker string, date_text string"))
    assert (good.count(), bad.count()) == (1, 2)


def test_envelopes(spark):
    texts = ['{"status":"OK","resultsCount":1,"results":[{"t":1704153600000,"o":1,"h":2,"l":0.5,"c":1.5,"v":10,"vw":1.2}]}', '{"status":"ERROR"}', '{"status":"DELAYED","resultsCount":0}', '{"status":"OK","resultsCount":0}', "not json"]
    parsed = files.parse_aggregates(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert [r.error_class for r in parsed.collect()] == [None, "ResponseError", "DelayedDataError", "NoDataError", "ResponseError"]
    assert str(files.bars_of(parsed).first().time) == "2024-01-02 00:00:00"
    with pytest.raises(RequestError):
        files.BarsRequest("AAPL", "2024-02-01", "2024-01-01")
    with pytest.raises(RequestError):
        files.BarsRequest("AAPL", "2024-01-01", "2024-02-01", span="year")
    assert files.with_endpoint(spark.createDataFrame([("TRADES",), ("TECHNICALINDICATORS",)], "kind string")).filter("path = 'UNKNOWN'").count() == 1


def test_store(spark, caplog):
    rows = bars(spark, [1, 2, 3])
    tables = {"asset_data": rows}
    assert store.scan(tables, "nope", store.Scan()) is None
    assert column(store.scan(tables, "asset_data", store.Scan(start="2024-01-02", limit=-1)), "close", "date") == [2.0, 3.0]
    assert store.delete(rows, "A", "2024-01-02").count() == 2
    assert store.update(rows, "A", "2024-01-02", {"close": 9.0}).filter("close = 9").count() == 1
    assert store.is_empty(rows.limit(0)) and not store.is_empty(rows)
    assert not store.execute(spark, "SELECT * FROM there_is_no_such_table")


def test_surface(spark):
    rows = spark.createDataFrame([("U", 1, 100.0, 1.0), ("U", 1, 101.0, 2.0), ("U", 1, 103.0, 6.0)], "underlying string, expiry_days int, strike double, mid double")
    got = {r.strike: r.mid for r in surface.densify(rows, ["underlying"]).collect()}
    assert got[100.5] == 1.5 and got[102.0] == 4.0 and got[103.5] == 6.0
    cubic = {r.strike: r.mid for r in surface.cubic(rows, ["underlying"]).collect()}
    assert cubic[101.0] == pytest.approx(2.0) and cubic[103.5] == pytest.approx(6.0)


def test_mid(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 9.0), (0.0, 0.0, 3.5)], "b double, a double, l double")
    assert [r.m for r in rows.select(surface.mid(F.col("b"), F.col("a"), F.col("l")).alias("m")).collect()] == [1.5, 3.5]


def test_orders_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, "A", "buy", 10, 5.0), (1, 2, "A", "sell", 20, 5.0), (1, 3, "A", "sell", 10, 6.0), (1, 4, "A", "buy", 1000, 1.0)], "account long, seq long, ticker string, side string, quantity long, price double")
    got = portfolio.replay_orders(rows, 100.0).orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, False, True, False]
    assert got[-1].cash == 110.0


def test_orders_across_batches(spark):
    """An account's state outlives a batch, ends with the account, and an order without quantity or price is refused."""
    orders = [(1, 1, "A", "buy", 10, 5.0), (1, 2, "A", "buy", None, 5.0), (1, 3, "B", "buy", 5, 10.0), (1, 4, "A", "sell", 10, 7.0), (1, 5, "A", "sell", 1, 7.0), (1, 6, "B", "sell", 2, None)]
    rows = [*orders, *[(2, *o[1:]) for o in orders], *[(None, *o[1:]) for o in orders]]
    df = spark.createDataFrame(rows[::-1], "account long, seq long, ticker string, side string, quantity long, price double").withColumn("x", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = portfolio.replay_orders(df, 100.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for account in (1, 2, None):
        own = sorted((r for r in got if r.account == account), key=lambda r: r.seq)
        assert [(r.accepted, r.cash, r.position) for r in own] == [(True, 50.0, 10), (False, 50.0, 10), (True, 0.0, 5), (True, 70.0, 0), (False, 70.0, 0), (False, 70.0, 5)]
    assert portfolio.replay_orders(df.limit(0), 100.0).count() == 0


def test_strategies(spark):
    got = backtest.figures(backtest.buy_hold(bars(spark, [10, 20, 10]))).first()
    assert got.final_value == pytest.approx(10_000.0) and got.max_drawdown == pytest.approx(-0.5)
    assert portfolio.as_of_prices(bars(spark, [1]).select("ticker", F.date_add("date", 5).alias("date")), bars(spark, [7, 8])).first().as_of_close == 8.0


def stream_of(spark, path, df):
    df.repartition(3).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_stream_parity(spark, tmp_path):
    from bourse.streaming import ticks as S

    trades = spark.createDataFrame([("A", 0, 10.0, 100, 0), ("A", 1, 11.0, 50, 1), ("A", 1, 12.0, 50, 2), ("A", 3, 9.0, 200, 3), ("A", 10, 10.0, 0, 4)], "ticker string, sec long, price double, qty long, seq long")
    trades = trades.withColumn("ts", F.timestamp_seconds(F.col("sec") + DAYS))
    got = S.drain(stream_of(spark, tmp_path / "t", trades), lambda rows: S.rolling_vwap(rows, 3))
    assert column(got, "vwap", "seq") == pytest.approx([10.0, 10.333333, 10.75, 9.833333, 0.0], abs=1e-6)
    quotes = spark.createDataFrame([(1, i, *q) for i, q in enumerate(QUOTES)], "symbol long, seq long, action string, side string, price double, size long")
    quotes = quotes.withColumn("ts", F.timestamp_seconds(F.col("seq") + DAYS))
    assert [(r.best_bid, r.best_ask) for r in S.drain(stream_of(spark, tmp_path / "q", quotes), S.best_quotes).orderBy("seq").collect()] == BEST
    orders = spark.createDataFrame([(0, 1, 0), (1, 2, 1), (5, 1, 2), (6, 1, 3), (20, 2, 4)], "ts long, order_id long, seq long")
    assert column(drained_orders(spark, tmp_path, orders, 5), "ts", "seq") == [5, 6]


#: Whole days, in seconds, by which small event times are moved: a stream's first watermark is the start of 1970.
DAYS = 10_000 * 86_400


def drained_orders(spark, tmp_path, orders, horizon):
    from bourse.streaming import ticks as S

    stream = stream_of(spark, tmp_path / "o", orders.withColumn("ts", F.timestamp_seconds(F.col("ts") + DAYS)))
    got = S.drain(stream, lambda rows: S.duplicate_orders(rows.withColumn("ts", F.unix_seconds("ts")), horizon))
    return got.withColumn("ts", F.col("ts") - DAYS)


def test_streams_are_drained_into_files(spark, tmp_path):
    from bourse.operators import orderflow
    from bourse.streaming import ticks as S

    day = 86_400
    secs = [5, day - 40, day - 2, day - 1, day, day, day + 1, 3 * day - 1, 3 * day + 9]
    trades = spark.createDataFrame([("A", s, 10.0 + i, 1 + i, i) for i, s in enumerate(secs)], "ticker string, sec long, price double, qty long, seq long")
    trades = trades.withColumn("ts", F.timestamp_seconds("sec"))
    stream = stream_of(spark, tmp_path / "t", trades)
    assert "_chunk" in S.rolling_vwap(stream, 30)._jdf.queryExecution().analyzed().toString()  # a ticker's rows don't meet in one frame
    got = S.drain(stream, lambda rows: S.rolling_vwap(rows, 30))
    assert got.inputFiles() and got.count() == len(secs)
    assert column(got, "vwap", "seq") == pytest.approx(column(orderflow.rolling_vwap(trades, 30), "vwap", "seq"))
    orders = trades.select(F.col("sec").alias("ts"), F.lit(1).cast("long").alias("order_id"), "seq")
    got = drained_orders(spark, tmp_path, orders, 50)
    assert got.inputFiles() and column(got, "ts", "seq") == column(orderflow.duplicate_orders(orders, 50), "ts", "seq")
    bars = trades.withColumn("ts", F.timestamp_seconds("sec"))
    got = S.drain(stream_of(spark, tmp_path / "b", bars), S.tumbling_bars)
    assert got.inputFiles() and column(got, "n", "start") == [4, 3, 1, 1]


def _ticks_with_gaps(spark):
    import datetime
    import random

    rng = random.Random(4)
    rows = []
    for i in range(700):
        ms = None if i % 97 == 0 else rng.randrange(0, 400_000, 500)
        ts = None if ms is None else datetime.datetime(2024, 1, 1, 23, 57) + datetime.timedelta(milliseconds=ms)
        rows.append((rng.choice(["A", "B", None]), None if ms is None else ms // 1000, ts, None if rng.random() < 0.6 else 10 + rng.randrange(500) / 100, rng.choice([0, 0, None, 1, 7]), i))
    return spark.createDataFrame(rows, "ticker string, sec long, ts timestamp_ntz, price double, qty long, seq long"), rows


@pytest.mark.parametrize("seconds, chunk", [(3, 10), (60, 10), (5, 86_400)])
def test_rolling_vwap_equals_sql_with_gaps(spark, seconds, chunk):
    """Null prices, quantities, times and tickers, and windows without volume, as SQL has them."""
    import duckdb
    import pandas as pd

    df, rows = _ticks_with_gaps(spark)
    ticks = pd.DataFrame(rows, columns=["ticker", "sec", "ts", "price", "qty", "seq"]).astype({"sec": "Int64", "qty": "Int64"})
    ticks["ts"] = pd.to_datetime(ticks["ts"])
    con = duckdb.connect()
    con.register("given", ticks)
    con.sql("CREATE TABLE ticks AS SELECT *, floor(CASE WHEN price = price THEN price END * 10000 + 0.5) * qty AS pq FROM given")
    flat = lambda x: sorted((a, None if b is None or b != b else round(b, 9)) for a, b in x)
    want = con.sql(f"""WITH s AS (SELECT seq, sum(pq) OVER r - coalesce(sum(pq) OVER l, 0) AS num, sum(qty) OVER r - coalesce(sum(qty) OVER l, 0) AS den FROM ticks WINDOW r AS (PARTITION BY ticker ORDER BY sec RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW),
        l AS (PARTITION BY ticker, sec ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT seq, CASE WHEN den = 0 THEN 0.0 ELSE num / den / 10000 END FROM s""").fetchall()
    got = orderflow.rolling_vwap(df, seconds, chunk=chunk)
    assert got.columns == [*df.columns, "vwap"] and flat(got.select("seq", "vwap").collect()) == flat(want)
    want = con.sql(f"SELECT seq, sum(pq) OVER w / nullif(sum(qty) OVER w, 0) / 10000 FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW)").fetchall()
    got = orderflow.rolling_vwap_continuous(df, seconds, chunk=chunk)
    assert got.columns == [*df.columns, "vwap"] and flat(got.select("seq", "vwap").collect()) == flat(want)


def test_rolling_windows_are_running_sums(spark):
    """No frame slides: a sliding one is summed anew for each row, which grows with the square of a window's rows."""
    df, _ = _ticks_with_gaps(spark)
    for rows in (orderflow.rolling_vwap(df, 3600), orderflow.rolling_vwap_continuous(df, 3600)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedpreceding" in plan and "specifiedwindowframe(rangeframe, -" not in plan

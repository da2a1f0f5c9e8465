"""Queries over bars, ticks and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols
from ..functions.numeric import fix, two_decimals
from ..operators import board, quantiles, series
from ..sources import durable, files, store, views
from ..sources.shared import shared_path
from .registry import query, sql_fix

TICKER, START, END = "Brand#12", "1996-01-01", "1998-12-31"
_BAR = "ticker, date, open, high, low, close, volume, vw, n"


@query(f"SELECT {_BAR} FROM bars")
def daily_bars(spark, sf_dir):
    return views.bars(spark, sf_dir)


def _rebar_sql(span):
    return f"""SELECT ticker, CAST(date_trunc('{span}', date) AS DATE) AS start, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(n) AS BIGINT) AS n
        FROM bars GROUP BY 1, 2"""


@query(_rebar_sql("week"))
def weekly_bars(spark, sf_dir):
    return series.rebar(views.bars(spark, sf_dir), 1, "week")


@query(_rebar_sql("month"))
def monthly_bars(spark, sf_dir):
    return series.rebar(views.bars(spark, sf_dir), 1, "month")


@query(
    """SELECT ticker, date_trunc('hour', ts) AS start, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume,
    """ + sql_fix("sum(price * qty) / nullif(sum(qty), 0)", 4) + """ AS vw, count(*) AS n FROM ticks GROUP BY 1, 2"""
)
def hourly_tick_bars(spark, sf_dir):
    rows = views.ticks(spark, sf_dir).withColumn("start", series.bucket_start("ts", 1, "hour"))
    return series.ohlcv(rows, ["ticker", "start"], "seq")


_SCAN = f"SELECT {_BAR} FROM bars WHERE ticker = '{TICKER}' AND date >= DATE '{START}' AND date <= DATE '{END}' ORDER BY date"


@query(_SCAN + " LIMIT 100")
def asset_range_scan(spark, sf_dir):
    return store.scan({"asset_data": views.bars(spark, sf_dir)}, "asset_data", store.Scan(TICKER, START, END, limit=100))


@query(f"SELECT {_BAR} FROM bars WHERE date <= DATE '{END}' ORDER BY date DESC NULLS LAST, ticker LIMIT 1000")
def asset_range_desc(spark, sf_dir):
    return store.scan({"asset_data": views.bars(spark, sf_dir)}, "asset_data", store.Scan(end=END, ascending=False))


@query(f"SELECT {_BAR} FROM bars WHERE date >= DATE '{START}' ORDER BY date NULLS FIRST, ticker LIMIT 50 OFFSET 200")
def asset_page(spark, sf_dir):
    return store.scan({"asset_data": views.bars(spark, sf_dir)}, "asset_data", store.Scan(start=START, limit=store.page_limit("50"), offset=200))


@query(f"SELECT date, close, volume FROM bars WHERE ticker = '{TICKER}' AND date BETWEEN DATE '{START}' AND DATE '{END}'")
def price_history(spark, sf_dir):
    return store.scan({"asset_data": views.bars(spark, sf_dir)}, "asset_data", store.Scan(TICKER, START, END, limit=-1)).select("date", "close", "volume")


@query("SELECT id, ticker, date, stock_name, exchange, sector, high_price, low_price, volume FROM stock_bars WHERE sector LIKE '%BRASS' OR exchange = 'ASIA'")
def stock_scan(spark, sf_dir):
    return views.stock_bars(spark, sf_dir).filter(F.col("sector").endswith("BRASS") | (F.col("exchange") == "ASIA"))


_KNOWN = "(SELECT DISTINCT o_custkey AS id FROM orders)"


@query(f"SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN {_KNOWN}")
def fk_valid(spark, sf_dir):
    child = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return store.owned(child, views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query(f"SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN {_KNOWN}")
def fk_orphans(spark, sf_dir):
    child = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return store.orphans(child, views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query(f"SELECT ticker, date, close, volume FROM bars WHERE NOT (ticker = '{TICKER}' AND date BETWEEN DATE '{START}' AND DATE '{END}') UNION ALL SELECT 'NEW', DATE '2002-01-01', 1.5, 10")
def insert_delete(spark, sf_dir):
    rows = store.delete(views.bars(spark, sf_dir).select("ticker", "date", "close", "volume"), TICKER, START, END)
    return store.insert(rows, spark.createDataFrame([("NEW", "2002-01-01", 1.5, 10)], "ticker string, date string, close double, volume long").withColumn("date", F.to_date("date")))


@query(f"SELECT ticker, date, CASE WHEN ticker = '{TICKER}' AND date = DATE '1997-06-02' THEN 9.5 ELSE close END AS close FROM bars")
def update_bar(spark, sf_dir):
    return store.update(views.bars(spark, sf_dir).select("ticker", "date", "close"), TICKER, "1997-06-02", {"close": 9.5})


@query(
    f"""SELECT ticker, date, CASE WHEN ticker = '{TICKER}' AND date = DATE '1995-06-02' THEN 9.5 ELSE close END AS close, volume FROM bars WHERE NOT (ticker = '{TICKER}' AND date BETWEEN DATE '{START}' AND DATE '{END}')
    UNION ALL SELECT 'NEW', DATE '2002-01-01', 1.5, CAST(10 AS BIGINT)"""
)
def durable_writes(spark, sf_dir):
    """An insert, a delete and an update committed to a stored table, and what a reader then sees."""
    rows = views.bars(spark, sf_dir).select("ticker", "date", "close", "volume")
    table = durable.DurableTable(spark, shared_path(spark, "durable"), rows.schema)
    table.insert(rows)
    table.delete(TICKER, START, END)
    table.insert(spark.createDataFrame([("NEW", "2002-01-01", 1.5, 10)], "ticker string, date string, close double, volume long").withColumn("date", F.to_date("date")))
    table.update(TICKER, "1995-06-02", {"close": 9.5})
    return table.read()


@query(f"SELECT ticker, count(*) AS n, {sql_fix('quantile_cont(price, 0.01)', 6)} AS p01, {sql_fix('quantile_cont(price, 0.5)', 6)} AS p50, {sql_fix('quantile_cont(price, 0.99)', 6)} AS p99 FROM trades GROUP BY ticker")
def price_quantiles(spark, sf_dir):
    """Exact quantiles of each ticker's prices, selected over several passes where a ticker has more than a thousand."""
    rows = quantiles.percentiles(views.trades(spark, sf_dir), "ticker", "price", [0.01, 0.5, 0.99], small=1000)
    return rows.select("ticker", "n", *[fix(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p01", "p50", "p99"))])


@query("SELECT ticker, count(*) AS n FROM trades GROUP BY ticker")
def table_counts(spark, sf_dir):
    return views.trades(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_BAR} FROM bars WHERE date = DATE '1997-06-02'")
def grouped_daily(spark, sf_dir):
    return views.bars(spark, sf_dir).filter("date = DATE '1997-06-02'")


@query(f"SELECT ticker, date, open, close, high, low FROM bars WHERE ticker = '{TICKER}' AND date = (SELECT min(date) FROM bars WHERE ticker = '{TICKER}')")
def daily_open_close(spark, sf_dir):
    rows = views.bars(spark, sf_dir).filter(F.col("ticker") == TICKER)
    return series.last_by(rows, "ticker", F.negative(F.unix_date("date")), "date", "open", "close", "high", "low")


@query("SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close FROM bars")
def previous_close(spark, sf_dir):
    return series.previous_close(views.bars(spark, sf_dir)).select("ticker", "date", "close", "prev_close")


@query("SELECT ticker, arg_max(seq, ts) AS seq, arg_max(price, ts) AS price, arg_max(qty, ts) AS qty, max(ts) AS ts FROM ticks GROUP BY ticker")
def last_trade(spark, sf_dir):
    return series.last_by(views.ticks(spark, sf_dir), "ticker", "ts", "seq", "price", "qty", "ts")


@query("SELECT ticker, " + sql_fix("250 * arg_max(price, ts)", 2) + " AS converted FROM ticks GROUP BY ticker")
def currency_conversion(spark, sf_dir):
    return series.last_by(views.ticks(spark, sf_dir), "ticker", "ts", "price").select("ticker", fix(250 * F.col("price"), 2).alias("converted"))


@query(
    f"""SELECT {_BAR}, prev_close, {sql_fix("100 * (close - prev_close) / prev_close", 4)} AS change FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close FROM bars)
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"""
)
def snapshot_all(spark, sf_dir):
    return series.snapshot(views.bars(spark, sf_dir))


@query(
    f"""SELECT ticker, count(*) AS n, {sql_fix("avg(close)", 4)} AS avg_close, max(close) AS max_close, min(close) AS min_close, CASE WHEN count(*) < 2 THEN 0.0 ELSE {sql_fix("stddev_pop(close)", 4)} END AS volatility FROM bars GROUP BY ticker"""
)
def series_stats(spark, sf_dir):
    return series.stats(views.bars(spark, sf_dir)).withColumns({c: fix(F.col(c), 4) for c in ("avg_close", "volatility")})


@query(f"SELECT ticker, {sql_fix('avg(close)', 4)} AS ma FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 20) GROUP BY ticker HAVING count(*) = 20")
def moving_average_last(spark, sf_dir):
    return series.last_average(views.bars(spark, sf_dir), 20).withColumn("ma", fix(F.col("ma"), 4))


@query(
    f"""SELECT ticker, date, close, CASE WHEN count(*) OVER w = 20 THEN {sql_fix("avg(close) OVER w", 4)} END AS ma FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
)
def moving_average_sliding(spark, sf_dir):
    return series.moving_average(views.bars(spark, sf_dir), 20).select("ticker", "date", "close", fix(F.col("ma"), 4).alias("ma"))


@query(f"SELECT ticker, date, {sql_fix('100 * (close - prev) / prev', 4)} AS change FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars)")
def pct_change(spark, sf_dir):
    return series.pct_change(views.bars(spark, sf_dir)).select("ticker", "date", fix(F.col("change"), 4).alias("change"))


@query("SELECT ticker, date, open, high, low, close, r FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars) WHERE r <= 50")
def last_50_candles(spark, sf_dir):
    return series.last_rows(views.bars(spark, sf_dir), 50).select("ticker", "date", "open", "high", "low", "close", F.col("r").cast("long").alias("r"))


@query(
    f"""SELECT ticker, date, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS colour, {sql_fix("abs(close - open)", 2)} AS body, {sql_fix("high - low", 2)} AS wick, {sql_fix("(open + close) / 2", 3)} AS body_mid, {sql_fix("(high + low) / 2", 3)} AS wick_mid FROM bars"""
)
def candle_shape(spark, sf_dir):
    rows = series.candle(views.bars(spark, sf_dir))
    return rows.select("ticker", "date", "colour", *[fix(F.col(c), d).alias(c) for c, d in (("body", 2), ("wick", 2), ("body_mid", 3), ("wick_mid", 3))])


@query("SELECT ticker, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS value FROM bars GROUP BY 1, 2")
def monthly_values(spark, sf_dir):
    return views.bars(spark, sf_dir).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("value"))


@query("SELECT ticker, CAST(trunc(arg_max(vw, date)) AS BIGINT) AS at_the_money, arg_max(vw, date) AS current_price FROM bars GROUP BY ticker")
def at_the_money(spark, sf_dir):
    return series.last_by(views.bars(spark, sf_dir), "ticker", "date", "vw").select("ticker", F.col("vw").cast("long").alias("at_the_money"), F.col("vw").alias("current_price"))


@query("SELECT ticker, price, change, 'up' AS direction FROM board WHERE change > 0 ORDER BY change DESC, ticker LIMIT 5")
def top_gainers(spark, sf_dir):
    return board.gainers(views.board(spark, sf_dir)).withColumn("direction", F.when(F.col("change") >= 0, "up").otherwise("down"))


@query("SELECT ticker, price, change FROM board WHERE change < 0 ORDER BY change, ticker LIMIT 5")
def top_losers(spark, sf_dir):
    return board.losers(views.board(spark, sf_dir))


@query("""SELECT ticker, date, close, 'src' AS source FROM bars WHERE lower(ticker) LIKE '%#1%'""")
def asset_search(spark, sf_dir):
    return store.search(views.bars(spark, sf_dir), "#1", "ticker").select("ticker", "date", "close", F.lit("src").alias("source"))


@query(f"SELECT {_BAR} FROM bars")
def json_envelope(spark, sf_dir):
    """Bars served as one vendor envelope per ticker and parsed back."""
    rows = views.bars(spark, sf_dir)
    result = F.struct((F.unix_date("date").cast("long") * 86_400_000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("double").alias("v"), "vw", "n")
    month = F.trunc("date", "month").alias("month")  # an envelope holds a month at most
    sent = rows.groupBy("ticker", month).agg(F.to_json(F.struct(F.lit("OK").alias("status"), F.count(F.lit(1)).alias("resultsCount"), F.collect_list(result).alias("results"))).alias("value")).drop("month")
    got = files.bars_of(files.parse_aggregates(sent))
    return got.select("ticker", F.to_date("time").alias("date"), F.col("open_price").alias("open"), F.col("highest_price").alias("high"), F.col("lowest_price").alias("low"), F.col("close_price").alias("close"), F.col("volume").cast("long").alias("volume"), F.col("volume_weighted").alias("vw"), "n")


@query("SELECT id, ticker, open_price, close_price, high_price, low_price, volume, date FROM (SELECT row_number() OVER (PARTITION BY ticker ORDER BY date) AS id, ticker, open AS open_price, close AS close_price, high AS high_price, low AS low_price, volume, date FROM bars)")
def csv_roundtrip(spark, sf_dir):
    """Bars exported to CSV in the shared folder and read back."""
    from pyspark.sql import Window as W

    path = shared_path(spark, "csv")
    rows = views.bars(spark, sf_dir).select(
        F.row_number().over(W.partitionBy("ticker").orderBy("date")).cast("long").alias("id"), "ticker", F.col("open").alias("open_price"), F.col("close").alias("close_price"), F.col("high").alias("high_price"),
        F.col("low").alias("low_price"), "volume", "date",
    )
    files.write_csv(rows, path)
    return files.read_csv(spark, path, "asset_data")


#: The vendor's addresses in SQL, by kind: e is the endpoint, s the symbol, b the bare one.
_ADDRESSES = {
    "AGGREGATES": "e || s || '/range/2/hour/2024-01-01/2024-02-01?adjusted=true&sort=asc&limit=50'",
    "GROUPEDDAILY": "e || l || '2024-01-09?adjusted=true'",
    "DAILYOPENCLOSE": "e || s || '/2024-01-09?adjusted=true'",
    "PREVIOUSCLOSE": "e || s || '/prev?adjusted=true'",
    **dict.fromkeys(("TRADES", "QUOTES"), "e || s || '?limit=50'"),
    **dict.fromkeys(("LASTTRADE", "LASTQUOTE", "TICKERDETAILSV3", "RELATEDCOMPANIES", "OPTIONCONTRACT", "SNAPSHOTSUNIVERSALSNAPSHOT"), "e || s"),
    **dict.fromkeys(("LASTTRADECRYPTOPAIR", "LASTQUOTECURRENCYPAIR"), "e || substr(b, 1, 3) || '/' || substr(b, 4, 3)"),
    "REALTIMECURRENCYCONVERSION": "e || substr(b, 1, 3) || '/' || substr(b, 4, 3) || '?amount=25'",
    "SNAPSHOTSOPTIONCONTRACT": "e || s || '/'",
    "SNAPSHOTSOPTIONCHAIN": "e || s || '?limit=50'",
    "SNAPSHOTSALLTICKERS": "e || l || 'tickers?tickers=' || s",
    "SNAPSHOTSGAINERSLOSERS": "e || l || 'gainers'",
    "SNAPSHOTSTICKER": "e || l || 'tickers/' || s",
    "TICKERS": "e || 'ticker=' || s || '&limit=50'",
    "TICKEREVENTS": "e || s || '/events'",
    **dict.fromkeys(("TICKERNEWS", "STOCKSPLITSV3", "DIVIDENDSV3", "STOCKFINANCIALSVX", "IPOS"), "e || '50&ticker=' || s"),
    "OPTIONSCONTRACTS": "e || '50&underlying_ticker=' || s",
    **dict.fromkeys(("TICKERTYPES", "CONDITIONS", "EXCHANGES"), "e || a"),
    **dict.fromkeys(("MARKETHOLIDAYS", "MARKETSTATUS"), "split_part(e, '?', 1)"),
}
_KIND_NAMES = [*sorted(files.ENDPOINTS), "TECHNICALINDICATORS"]


@query(
    f"""WITH p(kind, e) AS (VALUES {", ".join(f"('{k}', '{e}')" for k, e in sorted(files.ENDPOINTS.items()))}), r AS (SELECT id, symbol AS s, CASE WHEN substr(symbol, 2, 1) = ':' THEN substr(symbol, 3) ELSE symbol END AS b,
        ([{", ".join(f"'{k}'" for k in _KIND_NAMES)}])[1 + id % {len(_KIND_NAMES)}] AS kind, CASE WHEN symbol LIKE 'C:%' THEN 'global/markets/fx/' WHEN symbol LIKE 'X:%' THEN 'global/markets/crypto/' ELSE 'us/markets/stocks/' END AS l,
        CASE substr(symbol, 1, 2) WHEN 'O:' THEN 'options' WHEN 'C:' THEN 'fx' WHEN 'X:' THEN 'crypto' WHEN 'I:' THEN 'indices' ELSE 'stocks' END AS a FROM symbols)
    SELECT id, r.kind, CASE r.kind {" ".join(f"WHEN '{k}' THEN {form}" for k, form in _ADDRESSES.items())} ELSE 'UNKNOWN' END AS address FROM r LEFT JOIN p ON p.kind = r.kind"""
)
def request_addresses(spark, sf_dir):
    """An address of every kind, and of one that has no endpoint."""
    kind = F.get(F.array(*map(F.lit, _KIND_NAMES)), (F.col("id") % len(_KIND_NAMES)).cast("int"))
    rows = views.symbols(spark, sf_dir).select("id", "symbol", kind.alias("kind"), F.lit("2024-01-01").alias("start"), F.lit("2024-02-01").alias("end"), F.lit("hour").alias("span"), F.lit(2).alias("multiplier"), F.lit(50).alias("limit"), F.lit(25).alias("amount"))
    return files.request_paths(rows).select("id", "kind", "address")


@query("SELECT p_brand AS ticker, any_value(l.close) AS last_price, any_value(l.date) AS last_updated, count(*) AS n_listings FROM part JOIN latest l ON l.ticker = p_brand GROUP BY 1 ORDER BY ticker LIMIT 10 OFFSET 5")
def asset_list(spark, sf_dir):
    listed = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.count(F.lit(1)).alias("n_listings"))
    rows = listed.join(views.latest(spark, sf_dir), "ticker").select("ticker", F.col("close").alias("last_price"), F.col("date").alias("last_updated"), "n_listings")
    return rows.orderBy("ticker").offset(5).limit(10)


@query(f"SELECT ticker, date, close FROM bars WHERE ticker = '{TICKER}' AND date > (SELECT max(date) FROM bars WHERE ticker = '{TICKER}') - 30")
def asset_with_history(spark, sf_dir):
    """One ticker's bars of its last 30 days."""
    from pyspark.sql import Window as W

    rows = views.bars(spark, sf_dir).filter(F.col("ticker") == TICKER)
    last = F.max("date").over(W.partitionBy("ticker"))
    return rows.withColumn("last", last).filter(F.col("date") > F.date_sub("last", 30)).select("ticker", "date", "close")


@query(
    """SELECT ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS start, arg_min(price, seq) AS open, arg_max(price, seq) AS close, count(*) AS n FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2"""
)
def history_5m(spark, sf_dir):
    rows = views.ticks(spark, sf_dir).filter("ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-12 00:00:00'")
    return series.ohlcv(rows.withColumn("start", series.bucket_start("ts", 5, "minute")), ["ticker", "start"], "seq").select("ticker", "start", "open", "close", "n")


_KINDS = sorted(files.ENDPOINTS)


@query(
    f"""WITH e AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{files.ENDPOINTS[k]}')" for i, k in enumerate(_KINDS))}, ({len(_KINDS)}, 'NONE', 'UNKNOWN')) AS p(i, kind, path))
    SELECT kind, path, count(*) AS n FROM part JOIN e ON e.i = p_partkey % {len(_KINDS) + 1} GROUP BY 1, 2"""
)
def endpoint_catalogue(spark, sf_dir):
    """Requests, a kind for each part, with their endpoints: how many go to each; a kind that isn't known has none."""
    kind = F.element_at(F.array(*map(F.lit, [*_KINDS, "NONE"])), (F.col("p_partkey") % (len(_KINDS) + 1) + 1).cast("int"))
    return files.with_endpoint(views.table(spark, sf_dir, "part").select(kind.alias("kind"))).groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))


@query()
def synthetic_candles(spark, sf_dir):
    """Fifty candles of each ticker that go on from its latest close."""
    return series.walks_from(views.latest(spark, sf_dir))


@query(
    """WITH a AS (SELECT p_brand AS ticker, p_partkey % 3000 - 5 AS index, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS index FROM bars)
    SELECT a.ticker, a.index, n, date, close, date IS NOT NULL AS in_range FROM a LEFT JOIN b ON a.ticker = b.ticker AND a.index = b.index"""
)
def bar_at(spark, sf_dir):
    """Bars by their index, some of them out of range."""
    asks = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker"), (F.col("p_partkey") % 3000 - 5).alias("index")).agg(F.count(F.lit(1)).alias("n"))
    return series.rows_at(views.bars(spark, sf_dir).select("ticker", "date", "close"), asks)


@query("SELECT symbol, arg_max(seq, seq) AS seq, arg_max(side, seq) AS side, arg_max(price, seq) AS price, arg_max(size, seq) AS size FROM quotes GROUP BY symbol")
def last_quote(spark, sf_dir):
    return series.last_by(views.quotes(spark, sf_dir), "symbol", "seq", "seq", "side", "price", "size")


@query("SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, CAST(to_json({'results': list({'date': date, 'volume': volume, 'n': n} ORDER BY date), 'count': count(*)}) AS VARCHAR) AS json FROM bars GROUP BY 1, 2")
def served_pages(spark, sf_dir):
    """A page for each ticker and month, as it is served: {results: [...], count}."""
    rows = views.bars(spark, sf_dir).select(F.struct("ticker", F.trunc("date", "month").alias("month")).alias("page"), "date", "volume", "n")
    return files.to_envelope(rows, "page").select("page.ticker", "page.month", "json")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 0.0 ELSE vol END AS implied_vol, CASE WHEN id % 5 = 0 THEN 0.0 ELSE strike END AS strike, CASE WHEN id % 3 = 0 THEN false ELSE is_call END AS is_call FROM contracts")
def option_records(spark, sf_dir):
    """Records with gaps, filled by their defaults."""
    gap = lambda k, c: F.when(F.col("id") % k != 0, F.col(c))
    return store.option_defaults(views.contracts(spark, sf_dir).select("id", gap(7, "vol").alias("implied_vol"), gap(5, "strike").alias("strike"), gap(3, "is_call").alias("is_call")))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'Option' WHEN id % 3 = 1 THEN 'Stock' ELSE 'Asset' END AS asset_type FROM contracts""")
def typed_rows(spark, sf_dir):
    """Rows of several kinds in one table, told apart by the columns that have values."""
    rows = views.contracts(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, "O:X").alias("option_symbol"), F.when(F.col("id") % 3 == 1, "X").alias("stock_name"))
    return store.typed(rows).select("id", "asset_type")


@query(f"SELECT ticker, {sql_fix('price', 2)} AS price, {sql_fix('change', 2)} AS change, CASE WHEN change >= 0 THEN 'up' ELSE 'down' END AS direction FROM board")
def board_display(spark, sf_dir):
    rows = views.board(spark, sf_dir)
    return rows.select("ticker", two_decimals(F.col("price")).alias("price"), two_decimals(F.col("change")).alias("change"), symbols.direction(F.col("change")).alias("direction"))


@query("SELECT id, symbol, symbol AS again FROM symbols")
def symbol_prefixes(spark, sf_dir):
    """Each symbol taken apart and put together again."""
    rows = views.symbols(spark, sf_dir)
    again = symbols.with_prefix(symbols.bare_symbol(F.col("symbol")), symbols.asset_class(F.col("symbol")))
    return rows.select("id", "symbol", again.alias("again"))


@query("SELECT n_nationkey AS id, n_name AS name, 'moved by ' || n_regionkey AS message FROM nation")
def alert_texts(spark, sf_dir):
    text = F.concat("n_name", F.lit(": moved by "), F.col("n_regionkey").cast("string"))
    name, message = symbols.alert_parts(text)
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), name.alias("name"), message.alias("message"))

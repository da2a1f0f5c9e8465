"""Queries over portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.numeric import fix
from ..functions.symbols import dividend_payout as payout
from ..functions.symbols import portfolio_type
from ..operators import board, portfolio
from ..sources import views
from .registry import query, sql_fix


def _positions(spark, sf_dir):
    return views.transactions(spark, sf_dir).select("portfolio_id", "ticker", "transaction_type", "quantity")


@query("SELECT portfolio_id, ticker, CAST(count(*) AS BIGINT) AS n FROM (SELECT portfolio_id, ticker FROM transactions UNION ALL SELECT portfolio_id, ticker FROM transactions WHERE transaction_type = 'sell') GROUP BY 1, 2")
def portfolio_union(spark, sf_dir):
    rows = _positions(spark, sf_dir)
    both = portfolio.union(rows.select("portfolio_id", "ticker", "quantity"), rows.filter("transaction_type = 'sell'").select("portfolio_id", "ticker", "quantity"))
    return portfolio.counts(both, ["portfolio_id", "ticker"], "quantity")


@query("SELECT portfolio_id, ticker FROM transactions WHERE transaction_type = 'buy' EXCEPT ALL SELECT portfolio_id, ticker FROM transactions WHERE transaction_type = 'sell'")
def portfolio_difference(spark, sf_dir):
    rows = _positions(spark, sf_dir)
    return portfolio.difference(rows.filter("transaction_type = 'buy'").select("portfolio_id", "ticker"), rows.filter("transaction_type = 'sell'").select("portfolio_id", "ticker"))


@query(
    f"""WITH t AS (SELECT unnest(['Stock', 'Option', 'Cash', 'FX', 'Crypto', 'Index']) AS asset_type), p AS (SELECT CASE WHEN symbol LIKE 'O:%' THEN 'Option' WHEN symbol LIKE 'X:%' THEN 'Crypto' WHEN symbol LIKE 'C:%' THEN 'FX' WHEN symbol LIKE 'I:%' THEN 'Index' ELSE 'Stock' END AS asset_type, p_retailprice AS v FROM symbols JOIN part ON p_partkey = id)
    SELECT asset_type, {sql_fix("coalesce(sum(v), 0)", 2)} AS value FROM t LEFT JOIN p USING (asset_type) GROUP BY 1"""
)
def combined_value(spark, sf_dir):
    from ..functions.symbols import asset_class

    price = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("vw"))
    rows = views.symbols(spark, sf_dir).join(price, "id").select(portfolio_type(asset_class(F.col("symbol"))).alias("asset_type"), "vw")
    return portfolio.value_by_type(rows).withColumn("value", fix(F.col("value"), 2))


@query(f"SELECT portfolio_id, {sql_fix('sum(CASE WHEN transaction_type = ' + chr(39) + 'buy' + chr(39) + ' THEN -price * quantity ELSE price * quantity END)', 2)} AS balance FROM transactions GROUP BY 1")
def cash_ledger(spark, sf_dir):
    rows = views.transactions(spark, sf_dir)
    amount = F.when(F.col("transaction_type") == "buy", -F.col("price") * F.col("quantity")).otherwise(F.col("price") * F.col("quantity"))
    return portfolio.cash_balance(rows.select("portfolio_id", amount.alias("amount"))).withColumn("balance", fix(F.col("balance"), 2))


@query(f"SELECT portfolio_id, ticker, {sql_fix('2.5 / 100 * quantity * close', 4)} AS payout FROM holdings JOIN latest USING (ticker)")
def dividend_payout(spark, sf_dir):
    rows = views.holdings(spark, sf_dir).join(views.latest(spark, sf_dir).select("ticker", "close"), "ticker")
    return rows.select("portfolio_id", "ticker", fix(payout(F.lit(2.5), F.col("quantity"), F.col("close")), 4).alias("payout"))


@query("SELECT portfolio_id, ticker, quantity, avg_cost, realised, oversold FROM ledger")
def holdings_ledger(spark, sf_dir):
    """Every position that a portfolio ever had, with the cost basis of what is left, realised profit and what was sold beyond it."""
    return portfolio.basis(views.transactions(spark, sf_dir))


@query("SELECT username, p.portfolio_id, ticker, quantity, avg_cost FROM portfolios p LEFT JOIN holdings h ON h.portfolio_id = p.portfolio_id WHERE username LIKE '%1'")
def portfolio_holdings_join(spark, sf_dir):
    own = views.portfolios(spark, sf_dir).filter(F.col("username").endswith("1"))
    return own.join(views.holdings(spark, sf_dir), "portfolio_id", "left").select("username", "portfolio_id", "ticker", "quantity", "avg_cost")


_VALUED = """v AS (SELECT portfolio_id, ticker, quantity, avg_cost, close AS current_price, quantity * close AS value, quantity * (close - avg_cost) AS pnl, 100 * (close - avg_cost) / avg_cost AS pnl_pct FROM holdings JOIN latest USING (ticker))"""


@query(f"WITH {_VALUED} SELECT portfolio_id, ticker, quantity, avg_cost, current_price, {sql_fix('value', 2)} AS value, {sql_fix('pnl', 2)} AS pnl, {sql_fix('pnl_pct', 4)} AS pnl_pct, {sql_fix('100 * value / sum(value) OVER (PARTITION BY portfolio_id)', 4)} AS weight_pct FROM v")
def portfolio_summary(spark, sf_dir):
    rows = portfolio.valued(views.holdings(spark, sf_dir), views.latest(spark, sf_dir))
    return rows.withColumns({c: fix(F.col(c), d) for c, d in (("value", 2), ("pnl", 2), ("pnl_pct", 4), ("weight_pct", 4))})


_TOTALS = _VALUED + ", t AS (SELECT portfolio_id, sum(value) AS total_value, sum(quantity * avg_cost) AS initial_capital, sum(pnl) AS pl FROM v GROUP BY 1)"


def _totals(spark, sf_dir):
    rows = portfolio.valued(views.holdings(spark, sf_dir), views.latest(spark, sf_dir))
    return rows.groupBy("portfolio_id").agg(F.sum("value").alias("total_value"), F.sum(F.col("quantity") * F.col("avg_cost")).alias("initial_capital"), F.sum("pnl").alias("pl"))


@query(f"WITH {_TOTALS} SELECT portfolio_id, {sql_fix('total_value', 2)} AS total_value, {sql_fix('total_value - initial_capital', 2)} AS profit_loss, {sql_fix('100 * (total_value - initial_capital) / initial_capital', 4)} AS return_pct FROM t")
def portfolio_performance(spark, sf_dir):
    rows = portfolio.performance(_totals(spark, sf_dir))
    return rows.select("portfolio_id", fix(F.col("total_value"), 2).alias("total_value"), fix(F.col("profit_loss"), 2).alias("profit_loss"), fix(F.col("return_pct"), 4).alias("return_pct"))


@query(f"WITH {_VALUED} SELECT {sql_fix('CAST(sum(CAST(value AS DECIMAL(20, 4))) AS DOUBLE)', 2)} AS value, {sql_fix('CAST(sum(CAST(pnl AS DECIMAL(20, 4))) AS DOUBLE)', 2)} AS pl, count(DISTINCT portfolio_id) AS n FROM v")
def board_totals(spark, sf_dir):
    """Sums in whole ten-thousandths, in which prices and costs are exact, so that the order of summation doesn't count."""
    rows = portfolio.valued(views.holdings(spark, sf_dir), views.latest(spark, sf_dir))
    total = lambda c: N.two_decimals(F.sum(F.col(c).cast("decimal(20,4)")).cast("double"))
    return rows.agg(total("value").alias("value"), total("pnl").alias("pl"), F.count_distinct("portfolio_id").alias("n"))


@query(f"WITH {_TOTALS}, r AS (SELECT portfolio_id, {sql_fix('pl', 2)} AS pl FROM t) (SELECT *, 'top' AS side FROM r ORDER BY pl DESC, portfolio_id LIMIT 5) UNION ALL (SELECT *, 'bottom' FROM r ORDER BY pl, portfolio_id LIMIT 5)")
def top_pl(spark, sf_dir):
    return board.extremes(_totals(spark, sf_dir).select("portfolio_id", fix(F.col("pl"), 2).alias("pl")), "pl", "portfolio_id")


@query(f"WITH {_TOTALS}, r AS (SELECT portfolio_id, {sql_fix('total_value', 2)} AS value FROM t) SELECT portfolio_id, value, CAST(floor(value / 1000) + 1 AS BIGINT) AS level, row_number() OVER (ORDER BY value DESC, portfolio_id) AS rank FROM r")
def leaderboard_rank(spark, sf_dir):
    rows = _totals(spark, sf_dir).select("portfolio_id", fix(F.col("total_value"), 2).alias("value"))
    return board.ranked(rows, "value", "portfolio_id").select("portfolio_id", "value", board.level(F.col("value")).cast("long").alias("level"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VALUED} SELECT portfolio_id, ticker, value, rank FROM (SELECT portfolio_id, ticker, {sql_fix('value', 2)} AS value, row_number() OVER (PARTITION BY portfolio_id ORDER BY {sql_fix('value', 2)} DESC, ticker) AS rank FROM v) WHERE rank <= 3")
def top_holdings(spark, sf_dir):
    rows = portfolio.valued(views.holdings(spark, sf_dir), views.latest(spark, sf_dir)).select("portfolio_id", "ticker", fix(F.col("value"), 2).alias("value"))
    return board.top_per_group(rows, "portfolio_id", "value", "ticker", 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT username, balance FROM portfolios WHERE portfolio_id IN (SELECT portfolio_id FROM transactions WHERE transaction_type = 'sell')")
def friends_only(spark, sf_dir):
    friends = views.transactions(spark, sf_dir).filter("transaction_type = 'sell'").select("portfolio_id")
    return board.only_friends(views.portfolios(spark, sf_dir), friends, "portfolio_id").select("username", "balance")


@query("SELECT t.portfolio_id, t.ticker, t.date, t.quantity, b.close AS as_of_close FROM (SELECT portfolio_id, ticker, date + 3 AS date, quantity FROM transactions) t ASOF LEFT JOIN bars b ON b.ticker = t.ticker AND b.date <= t.date")
def as_of_valuation(spark, sf_dir):
    rows = views.transactions(spark, sf_dir).select("portfolio_id", "ticker", F.date_add("date", 3).alias("date"), "quantity")
    return portfolio.as_of_prices(rows, views.bars(spark, sf_dir)).select("portfolio_id", "ticker", "date", "quantity", "as_of_close")


@query("SELECT ticker, arg_max(quantity, seq) AS weight FROM transactions GROUP BY ticker")
def weight_assignment(spark, sf_dir):
    return portfolio.weights_of(views.transactions(spark, sf_dir).select("ticker", F.col("quantity").alias("weight"), F.col("seq").alias("add_seq")))


_EQUAL = "(SELECT 1.0::DOUBLE / count(DISTINCT ticker) FROM months)"
_PAIRS = "c AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS cov, corr(x.ret, y.ret) AS r, count(*) AS n FROM returns x JOIN returns y ON x.date = y.date GROUP BY 1, 2)"


def _equal_weights(rets):
    names = rets.select("ticker").distinct()
    return names.withColumn("weight", F.lit(1.0) / names.count())


@query(f"SELECT {sql_fix('sum(mu / n)', 6)} AS expected_return FROM (SELECT avg(ret) AS mu, (SELECT count(DISTINCT ticker) FROM returns) AS n FROM returns GROUP BY ticker)")
def expected_return(spark, sf_dir):
    rets = views.returns(spark, sf_dir)
    return portfolio.expected_return(_equal_weights(rets), rets).select(fix(F.col("expected_return"), 6).alias("expected_return"))


@query(f"WITH {_PAIRS} SELECT {sql_fix('sqrt(sum(cov) / (max(k) * max(k)))', 6)} AS volatility FROM c, (SELECT count(DISTINCT ticker) AS k FROM returns)")
def portfolio_volatility(spark, sf_dir):
    rets = views.returns(spark, sf_dir)
    return portfolio.volatility(_equal_weights(rets), rets).select(fix(F.col("volatility"), 6).alias("volatility"))


@query(
    f"""WITH {_PAIRS}, m AS (SELECT ticker, avg(ret) AS mu FROM returns WHERE ticker IN ('Brand#11', 'Brand#12') GROUP BY 1), k AS (SELECT max(cov) FILTER (WHERE a = 'Brand#11' AND b = 'Brand#11') AS c11, max(cov) FILTER (WHERE a = 'Brand#12' AND b = 'Brand#12') AS c22, max(cov) FILTER (WHERE a = 'Brand#11' AND b = 'Brand#12') AS c12 FROM c),
    z AS (SELECT c22 * (SELECT mu FROM m WHERE ticker = 'Brand#11') - c12 * (SELECT mu FROM m WHERE ticker = 'Brand#12') AS z1, c11 * (SELECT mu FROM m WHERE ticker = 'Brand#12') - c12 * (SELECT mu FROM m WHERE ticker = 'Brand#11') AS z2 FROM k)
    SELECT 'Brand#11' AS ticker, {sql_fix("z1 / (z1 + z2)", 4)} AS weight FROM z UNION ALL SELECT 'Brand#12', {sql_fix("z2 / (z1 + z2)", 4)} FROM z"""
)
def tangency_two_asset(spark, sf_dir):
    rets = views.returns(spark, sf_dir).filter("ticker IN ('Brand#11', 'Brand#12')")
    return portfolio.optimise(rets).withColumn("weight", fix(F.col("weight"), 4))


@query()
def optimised_weights(spark, sf_dir):
    rets, out = views.returns(spark, sf_dir), None
    known = portfolio.moments(rets)
    for kind in portfolio.OPTIMISERS:
        one = portfolio.optimise(rets, kind, least=0.0, most=0.5, known=known).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


_SEQUENCE = "SELECT portfolio_id AS account, row_number() OVER (PARTITION BY portfolio_id ORDER BY date, seq) AS seq, ticker, transaction_type AS side, quantity, price FROM transactions"


@query(
    f"""WITH RECURSIVE o AS ({_SEQUENCE}), r AS (
        SELECT account, CAST(0 AS BIGINT) AS seq, NULL::VARCHAR AS ticker, NULL::VARCHAR AS side, NULL::BIGINT AS quantity, NULL::DOUBLE AS price, false AS accepted, 50000.0::DOUBLE AS cash, MAP([]::VARCHAR[], []::BIGINT[]) AS held FROM (SELECT DISTINCT account FROM o)
        UNION ALL SELECT account, seq, ticker, side, quantity, price, ok, CASE WHEN ok THEN cash - way * quantity * price ELSE cash END, CASE WHEN ok THEN map_concat(held, MAP([ticker], [own + way * quantity])) ELSE held END FROM (
            SELECT *, CASE side WHEN 'buy' THEN quantity * price <= cash ELSE own >= quantity END AS ok FROM (
                SELECT o.account, o.seq, o.ticker, o.side, o.quantity, o.price, r.cash, r.held, coalesce(r.held[o.ticker], 0) AS own, CASE o.side WHEN 'buy' THEN 1 ELSE -1 END AS way FROM r JOIN o ON o.account = r.account AND o.seq = r.seq + 1)))
    SELECT account, seq, ticker, side, quantity, price, accepted, {sql_fix("cash", 2)} AS cash, CAST(coalesce(held[ticker], 0) AS BIGINT) AS position FROM r WHERE seq > 0"""
)
def order_replay(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = views.transactions(spark, sf_dir)
    seq = F.row_number().over(W.partitionBy("portfolio_id").orderBy("date", "seq")).cast("long")
    return portfolio.replay_orders(rows.select(F.col("portfolio_id").alias("account"), seq.alias("seq"), "ticker", F.col("transaction_type").alias("side"), "quantity", "price"), 50_000.0).withColumn("cash", fix(F.col("cash"), 2))

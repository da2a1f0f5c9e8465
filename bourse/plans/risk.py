"""Queries over risk and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fix
from ..operators import backtest, book_risk, covariance, portfolio, quantiles, risk, series
from ..sources import views
from ..sources.shared import staged
from .holdings import _PAIRS
from .registry import query, sql_fix

_TICKS_RET = "SELECT * FROM (SELECT ticker, price / nullif(lag(price) OVER (PARTITION BY ticker ORDER BY ts), 0) - 1 AS ret FROM ticks) WHERE ret IS NOT NULL"


@query(f"SELECT ticker, {sql_fix('quantile_cont(ret, 0.05)', 6)} AS var_95, {sql_fix('quantile_cont(ret, 0.01) * sqrt(10)', 6)} AS var_99_10, {sql_fix('avg(ret) - 1.6448536269514722 * stddev_samp(ret)', 6)} AS parametric_95 FROM returns GROUP BY 1")
def var_historical(spark, sf_dir):
    rows = views.returns(spark, sf_dir).groupBy("ticker")
    return rows.agg(fix(risk.var_historical("ret", 0.95), 6).alias("var_95"), fix(risk.var_historical("ret", 0.99, 10), 6).alias("var_99_10"), fix(risk.var_parametric("ret", 0.95), 6).alias("parametric_95"))


@query()
def var_monte_carlo(spark, sf_dir):
    return risk.var_monte_carlo(views.returns(spark, sf_dir), 0.95)


@query(f"WITH c AS (SELECT ticker, quantile_cont(ret, 0.05) AS cut FROM returns GROUP BY 1) SELECT ticker, {sql_fix('avg(ret)', 6)} AS es FROM returns JOIN c USING (ticker) WHERE ret <= cut GROUP BY 1")
def expected_shortfall(spark, sf_dir):
    return risk.expected_shortfall(views.returns(spark, sf_dir), 0.95).withColumn("es", fix(F.col("es"), 6))


@query(f"WITH x AS ({_TICKS_RET}), c AS (SELECT ticker, quantile_cont(ret, 0.05) AS var FROM x GROUP BY 1) SELECT ticker, {sql_fix('var', 6)} AS var, {sql_fix('avg(ret)', 6)} AS es FROM x JOIN c USING (ticker) WHERE ret <= var GROUP BY ticker, var")
def tick_shortfall(spark, sf_dir):
    """Value at risk and expected shortfall of the price moves from tick to tick, whose quantiles are selected over several passes."""
    moves = series.returns(views.ticks(spark, sf_dir).select("ticker", F.col("ts").alias("date"), F.col("price").alias("close"))).filter("ret IS NOT NULL")
    return quantiles.expected_shortfall(moves, "ticker", "ret", 0.95, small=500).select("ticker", fix(F.col("var"), 6).alias("var"), fix(F.col("es"), 6).alias("es"))


_SHARPE = "(avg(ret) * 12 - 0.04) / (stddev_samp(ret) * sqrt(12))"
_SORTINO = "(avg(ret) * 12 - 0.04) / (sqrt(avg(pow(least(ret - 0.04 / 12, 0), 2))) * sqrt(12))"


@query(f"SELECT ticker, {sql_fix(_SHARPE, 5)} AS sharpe FROM returns GROUP BY 1")
def sharpe(spark, sf_dir):
    return views.returns(spark, sf_dir).groupBy("ticker").agg(fix(risk.sharpe("ret", periods=12), 5).alias("sharpe"))


_MARKET = "m AS (SELECT date, avg(ret) AS market FROM returns GROUP BY 1), x AS (SELECT * FROM returns JOIN m USING (date))"


@query(f"WITH {_MARKET} SELECT ticker, {sql_fix('regr_slope(ret, market)', 5)} AS beta, {sql_fix('regr_intercept(ret, market)', 6)} AS alpha, {sql_fix('corr(ret, market)', 5)} AS correlation, {sql_fix('regr_r2(ret, market)', 5)} AS r2 FROM x GROUP BY 1")
def beta_alpha(spark, sf_dir):
    rows = risk.with_benchmark(views.returns(spark, sf_dir)).groupBy("ticker")
    return rows.agg(*[fix(c, 6 if n == "alpha" else 5).alias(n) for n, c in risk.against_market().items()])


_CURVE = "e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS v FROM %s), dd AS (SELECT *, v / max(v) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM e)"


@query(f"WITH {_CURVE % 'returns'} SELECT ticker, {sql_fix('min(drawdown)', 6)} AS max_drawdown FROM dd GROUP BY 1")
def max_drawdown(spark, sf_dir):
    return risk.max_drawdown(views.returns(spark, sf_dir)).withColumn("max_drawdown", fix(F.col("max_drawdown"), 6))


@query(
    f"""WITH {_MARKET}, {_CURVE % "x"} SELECT ticker, {sql_fix("quantile_cont(ret, 0.05)", 6)} AS var_95, {sql_fix("quantile_cont(ret, 0.01)", 6)} AS var_99, {sql_fix(_SHARPE, 5)} AS sharpe, {sql_fix(_SORTINO, 5)} AS sortino, {sql_fix("regr_slope(ret, market)", 5)} AS beta,
    {sql_fix("regr_intercept(ret, market)", 6)} AS alpha, {sql_fix("min(drawdown)", 6)} AS max_drawdown, {sql_fix("stddev_samp(ret) * sqrt(12)", 6)} AS volatility, {sql_fix("corr(ret, market)", 5)} AS correlation FROM dd GROUP BY 1"""
)
def risk_bundle(spark, sf_dir):
    digits = {"sharpe": 5, "sortino": 5, "beta": 5, "correlation": 5}
    rows = risk.bundle(views.returns(spark, sf_dir))
    return rows.select("ticker", *[fix(F.col(c), digits.get(c, 6)).alias(c) for c in rows.columns if c != "ticker"])


@query(f"WITH {_PAIRS} SELECT a, b, {sql_fix('cov', 8)} AS cov, {sql_fix('r', 5)} AS corr, n FROM c")
def correlation_matrix(spark, sf_dir):
    return covariance.mirrored(covariance.upper(views.returns(spark, sf_dir))).select("a", "b", fix(F.col("cov"), 8).alias("cov"), fix(F.col("corr"), 5).alias("corr"), "n")


@query(f"WITH {_PAIRS} SELECT a, string_agg(b || '=' || CAST(CAST(floor(r * 1000 + 0.500001) AS BIGINT) AS VARCHAR), ' ' ORDER BY b) AS correlations FROM c GROUP BY 1")
def correlation_map(spark, sf_dir):
    """The nested form, in thousandths, shown as text."""
    nested = risk.correlation_map(covariance.mirrored(covariance.upper(views.returns(spark, sf_dir))))
    shown = F.transform(F.array_sort(F.map_entries("correlations")), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1000 + 0.500001).cast("string")))
    return nested.select("a", F.array_join(shown, " ").alias("correlations"))


#: Cyclical coordinate descent on w'Cw / 2 - sum(log w) / n, a coordinate a step.
_PARITY = f"""{_PAIRS}, k AS (SELECT list(v ORDER BY a) AS m, count(*) AS n, list(a ORDER BY a) AS names FROM (SELECT a, list(cov ORDER BY b) AS v FROM c GROUP BY a)),
    d(step, i, y) AS (SELECT 0, 1, list_transform(m, lambda row, i: 1 / sqrt(n * row[i])) FROM k
        UNION ALL SELECT step + 1, i % n + 1, list_concat(y[1:i - 1], [(sqrt(b * b + 4 * v / n) - b) / (2 * v)], y[i + 1:]) FROM (SELECT step, i, y, n, m[i][i] AS v, list_dot_product(m[i], y) - m[i][i] * y[i] AS b FROM d, k) WHERE step < 150 * n),
    e AS (SELECT list_transform(y, lambda x: x / list_sum(y)) AS w FROM d ORDER BY step DESC LIMIT 1),
    p AS (SELECT unnest(names) AS ticker, unnest(w) AS weight, unnest(list_transform(m, lambda row, i: w[i] * list_dot_product(row, w))) AS part, list_dot_product(w, list_transform(m, lambda row: list_dot_product(row, w))) AS whole FROM e, k)"""


@query(f"WITH RECURSIVE {_PARITY} SELECT ticker, {sql_fix('weight', 6)} AS weight, {sql_fix('part / whole', 6)} AS contribution FROM p")
def risk_parity(spark, sf_dir):
    """The weights of equal risk and each ticker's share of the variance, from Spark's covariances."""
    rets = staged(views.returns(spark, sf_dir), "returns")
    weights = portfolio.optimise(rets, "risk_parity")
    return portfolio.contributions(weights, rets).select("ticker", fix(F.col("weight"), 6).alias("weight"), fix(F.col("contribution"), 6).alias("contribution"))


_SERIES = """w AS (SELECT portfolio_id, ticker, quantity * close AS weight FROM holdings JOIN latest USING (ticker)), v AS (SELECT portfolio_id, sum(weight) AS value FROM w GROUP BY 1),
    s AS (SELECT portfolio_id, date, sum(weight * ret) / sum(weight) AS ret FROM w JOIN returns USING (ticker) GROUP BY 1, 2)"""


def _book(spark, sf_dir):
    """Portfolios' holdings by value, their values and the tickers' returns; what several plans read is staged once. Each query
    makes the portfolios' series, which are far larger, in the plan that reads them."""
    held = staged(portfolio.valued(views.holdings(spark, sf_dir), views.latest(spark, sf_dir)).select("portfolio_id", "ticker", F.col("value").alias("weight")), "held")
    rets = staged(views.returns(spark, sf_dir), "returns")
    return held, held.groupBy("portfolio_id").agg(F.sum("weight").alias("value")), rets


@query(f"WITH {_SERIES} SELECT portfolio_id, date, {sql_fix('ret', 6)} AS ret FROM s")
def portfolio_returns(spark, sf_dir):
    held, _, rets = _book(spark, sf_dir)
    return book_risk.returns_of(held, rets).withColumn("ret", fix(F.col("ret"), 6))


_AT_RISK = {"historical": "quantile_cont(ret, 0.05)", "parametric": "avg(ret) - 1.6448536269514722 * stddev_samp(ret)"}


@query(
    f"WITH {_SERIES} "
    + " UNION ALL ".join(
        f"SELECT portfolio_id, '{m}' AS method, {sql_fix('any_value(value)', 2)} AS portfolio_value, {sql_fix(f'100 * ({x})', 4)} AS var_percentage, {sql_fix(f'any_value(value) * ({x})', 2)} AS var_amount FROM s JOIN v USING (portfolio_id) GROUP BY portfolio_id" for m, x in _AT_RISK.items()
    )
)
def portfolio_var(spark, sf_dir):
    held, values, rets = _book(spark, sf_dir)
    rows = book_risk.values_at_risk(book_risk.returns_of(held, rets), values, 0.95, 1, tuple(_AT_RISK))
    return rows.select("portfolio_id", "method", fix(F.col("portfolio_value"), 2).alias("portfolio_value"), fix(F.col("var_percentage"), 4).alias("var_percentage"), fix(F.col("var_amount"), 2).alias("var_amount"))


@query()
def portfolio_var_monte_carlo(spark, sf_dir):
    held, values, rets = _book(spark, sf_dir)
    return book_risk.amounts(book_risk.monte_carlo(held, rets), values)


_BOOK_CURVE = "e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio_id ORDER BY date)) AS v FROM x), dd AS (SELECT *, v / max(v) OVER (PARTITION BY portfolio_id ORDER BY date) - 1 AS drawdown FROM e)"


@query(
    f"""WITH {_SERIES}, m AS (SELECT date, avg(ret) AS market FROM returns GROUP BY 1), x AS (SELECT * FROM s JOIN m USING (date)), {_BOOK_CURVE} SELECT portfolio_id, {sql_fix("quantile_cont(ret, 0.05)", 6)} AS var_95, {sql_fix("quantile_cont(ret, 0.01)", 6)} AS var_99,
    {sql_fix("(avg(ret) * 12 - 0.04) / (nullif(stddev_samp(ret), 0) * sqrt(12))", 5)} AS sharpe, {sql_fix("(avg(ret) * 12 - 0.04) / (nullif(sqrt(avg(pow(least(ret - 0.04 / 12, 0), 2))), 0) * sqrt(12))", 5)} AS sortino, {sql_fix("regr_slope(ret, market)", 5)} AS beta, {sql_fix("regr_intercept(ret, market)", 6)} AS alpha, {sql_fix("min(drawdown)", 6)} AS max_drawdown,
    {sql_fix("stddev_samp(ret) * sqrt(12)", 6)} AS volatility, {sql_fix("corr(ret, market)", 5)} AS correlation FROM dd GROUP BY 1"""
)
def portfolio_risk_bundle(spark, sf_dir):
    digits = {"sharpe": 5, "sortino": 5, "beta": 5, "correlation": 5}
    held, _, rets = _book(spark, sf_dir)
    rows = risk.bundle(book_risk.returns_of(held, rets), key="portfolio_id", market=rets.groupBy("date").agg(F.avg("ret").alias("market")))
    return rows.select("portfolio_id", *[fix(F.col(c), digits.get(c, 6)).alias(c) for c in rows.columns if c != "portfolio_id"])


@query(f"SELECT ticker, date, {sql_fix('ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date))', 6)} AS ret FROM bars")
def log_returns(spark, sf_dir):
    return series.returns(views.bars(spark, sf_dir), log=True).select("ticker", "date", fix(F.col("ret"), 6).alias("ret"))


@query(f"WITH {_CURVE % 'returns'} SELECT ticker, date, {sql_fix('v', 6)} AS value, {sql_fix('drawdown', 6)} AS drawdown FROM dd")
def equity_curve(spark, sf_dir):
    return series.drawdown(series.equity(views.returns(spark, sf_dir))).select("ticker", "date", fix(F.col("value"), 6).alias("value"), fix(F.col("drawdown"), 6).alias("drawdown"))


_POSITIONS = {
    "buy_hold": "SELECT *, 1.0::DOUBLE AS position FROM months",
    "ma_cross": """SELECT *, CASE WHEN count(*) OVER f = 3 AND count(*) OVER s = 6 AND avg(close) OVER f > avg(close) OVER s THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM months
        WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), s AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "momentum": """SELECT * EXCLUDE (past), CASE WHEN past IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY past DESC NULLS LAST, ticker) <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS position
        FROM (SELECT *, close / lag(close, 6) OVER (PARTITION BY ticker ORDER BY date) - 1 AS past FROM months)""",
    "momentum_held": """SELECT * EXCLUDE (past, chosen, turn, bar, turned, was), CASE WHEN bar - turned < 2 THEN was ELSE 0.0 END AS position FROM (
        SELECT *, last_value(CASE WHEN turn THEN bar END IGNORE NULLS) OVER w AS turned, last_value(CASE WHEN turn THEN chosen END IGNORE NULLS) OVER w AS was FROM (
            SELECT *, CASE WHEN past IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY past DESC NULLS LAST, ticker) <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS chosen,
            date = min(date) OVER (PARTITION BY date_trunc('quarter', date)) AS turn, row_number() OVER (PARTITION BY ticker ORDER BY date) AS bar
            FROM (SELECT *, close / lag(close, 6) OVER (PARTITION BY ticker ORDER BY date) - 1 AS past FROM months)) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "mean_reversion": """SELECT * EXCLUDE (z), CASE WHEN z < -1 THEN 1.0 WHEN z > 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS position FROM (SELECT *, CASE WHEN count(*) OVER w = 6 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z FROM months
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""",
}


def _trades_sql(name: str) -> str:
    return f"""p AS ({_POSITIONS[name]}), i AS (SELECT *, sum(turn) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT ticker, date, close, position, CASE WHEN position <> coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY date), 0) THEN 1 ELSE 0 END AS turn FROM p)),
        g AS (SELECT ticker, run, any_value(position) AS position, min(date) AS entry_date, arg_min(close, date) AS entry_price, max(date) AS last_date, arg_max(close, date) AS last_close FROM i GROUP BY 1, 2),
        l AS (SELECT *, lead(entry_date) OVER v AS next_date, lead(entry_price) OVER v AS next_price FROM g WINDOW v AS (PARTITION BY ticker ORDER BY run)),
        t AS (SELECT ticker, CASE WHEN position > 0 THEN 'long' ELSE 'short' END AS direction, entry_date, coalesce(next_date, last_date) AS exit_date, entry_price, coalesce(next_price, last_close) AS exit_price, position * 10000 / entry_price AS quantity,
            next_date IS NULL AS is_open, position * 10000 / entry_price * (coalesce(next_price, last_close) - entry_price) AS profit FROM l WHERE position <> 0)"""


def _figures_sql(name: str) -> str:
    return f"""{_trades_sql(name)}, r AS (SELECT *, greatest(coalesce(lag(position) OVER w * (close / lag(close) OVER w - 1), 0), -0.99) AS ret FROM p WINDOW w AS (PARTITION BY ticker ORDER BY date)), {_CURVE % "r"},
        k AS (SELECT ticker, 10000 * arg_max(v, date) AS final_value, count(*) AS n, min(drawdown) AS max_drawdown, (avg(ret) * 12 - 0.04) / (nullif(stddev_samp(ret), 0) * sqrt(12)) AS sharpe, (avg(ret) * 12 - 0.04) / (nullif(sqrt(avg(pow(least(ret - 0.04 / 12, 0), 2))), 0) * sqrt(12)) AS sortino FROM dd GROUP BY 1),
        f AS (SELECT k.*, coalesce(q.trades, 0) AS trades, coalesce(q.profitable, 0) AS profitable, q.profitable / q.trades AS win_rate, avg_win, avg_loss FROM k LEFT JOIN (
            SELECT ticker, count(*) AS trades, count(*) FILTER (WHERE profit > 0) AS profitable, avg(profit) FILTER (WHERE profit > 0) AS avg_win, avg(profit) FILTER (WHERE profit < 0) AS avg_loss FROM t GROUP BY 1) q USING (ticker))"""


def _report(rows):
    return rows.select(
        "ticker", fix(F.col("final_value"), 2).alias("final_value"), fix(F.col("total_return"), 6).alias("total_return"), fix(F.col("annual_return"), 6).alias("annual_return"), fix(F.col("max_drawdown"), 6).alias("max_drawdown"), fix(F.col("sharpe"), 5).alias("sharpe"),
        fix(F.col("sortino"), 5).alias("sortino"), fix(F.col("win_rate"), 6).alias("win_rate"), F.col("trades").cast("long").alias("trades"), F.col("profitable").cast("long").alias("profitable"), fix(F.col("avg_win"), 2).alias("avg_win"), fix(F.col("avg_loss"), 2).alias("avg_loss"),
    )


def _report_sql(name: str) -> str:
    return f"""WITH {_figures_sql(name)} SELECT ticker, {sql_fix("final_value", 2)} AS final_value, {sql_fix("final_value / 10000 - 1", 6)} AS total_return, {sql_fix("pow(final_value / 10000, 12.0 / n) - 1", 6)} AS annual_return, {sql_fix("max_drawdown", 6)} AS max_drawdown,
        {sql_fix("sharpe", 5)} AS sharpe, {sql_fix("sortino", 5)} AS sortino, {sql_fix("win_rate", 6)} AS win_rate, CAST(trades AS BIGINT) AS trades, CAST(profitable AS BIGINT) AS profitable, {sql_fix("avg_win", 2)} AS avg_win, {sql_fix("avg_loss", 2)} AS avg_loss FROM f"""


@query(f"WITH {_trades_sql('mean_reversion')} SELECT ticker, direction, entry_date, exit_date, entry_price, exit_price, {sql_fix('quantity', 4)} AS quantity, {sql_fix('abs(quantity) * entry_price', 2)} AS cost, {sql_fix('profit', 2)} AS profit, is_open FROM t")
def bt_trades(spark, sf_dir):
    """The list of round trips of a strategy that goes long and short."""
    rows = backtest.trades(backtest.mean_reversion(views.months(spark, sf_dir), 6, 1.0))
    return rows.withColumns({"quantity": fix(F.col("quantity"), 4), "cost": fix(F.col("cost"), 2), "profit": fix(F.col("profit"), 2)})


@query(_report_sql("buy_hold"))
def bt_buy_hold(spark, sf_dir):
    return _report(backtest.figures(backtest.buy_hold(views.months(spark, sf_dir))))


@query(_report_sql("ma_cross"))
def bt_ma_cross(spark, sf_dir):
    return _report(backtest.figures(backtest.ma_cross(views.months(spark, sf_dir), 3, 6)))


@query(_report_sql("momentum"))
def bt_momentum(spark, sf_dir):
    return _report(backtest.figures(backtest.momentum(views.months(spark, sf_dir), 6, 5)))


@query(_report_sql("momentum_held"))
def bt_momentum_held(spark, sf_dir):
    """Chosen each quarter, held for two months of it."""
    return _report(backtest.figures(backtest.momentum(views.months(spark, sf_dir), 6, 5, holding=2, rebalance="quarter")))


@query(_report_sql("mean_reversion"))
def bt_mean_reversion(spark, sf_dir):
    return _report(backtest.figures(backtest.mean_reversion(views.months(spark, sf_dir), 6, 1.0)))


@query(
    f"""WITH s AS (SELECT x.ticker || '/' || y.ticker AS ticker, x.date, x.close - y.close AS close FROM months x JOIN months y ON x.date = y.date WHERE x.ticker = 'Brand#11' AND y.ticker = 'Brand#12'),
    t AS (SELECT *, CASE WHEN count(*) OVER w = 6 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z FROM s WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
    SELECT ticker, date, close, {sql_fix("z", 6)} AS z, CASE WHEN z < -1 THEN 1.0 WHEN z > 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS position FROM t"""
)
def bt_pairs(spark, sf_dir):
    rows = backtest.pairs(views.months(spark, sf_dir), "Brand#11", "Brand#12", 6, 1.0)
    return rows.select("ticker", "date", "close", fix(F.col("z"), 6).alias("z"), "position")


def _compared_sql(name: str) -> str:
    return f"""SELECT '{name}' AS strategy, {sql_fix("avg(final_value / 10000 - 1)", 5)} AS total_return, {sql_fix("avg(sharpe)", 5)} AS sharpe, {sql_fix("min(max_drawdown)", 6)} AS max_drawdown, CAST(sum(trades) AS BIGINT) AS trades
        FROM (WITH {_figures_sql(name)} SELECT * FROM f)"""


@query(" UNION ALL ".join(_compared_sql(name) for name in _POSITIONS if name != "momentum_held"))
def bt_compare(spark, sf_dir):
    rows = backtest.compare(views.months(spark, sf_dir))
    return rows.select("strategy", fix(F.col("total_return"), 5).alias("total_return"), fix(F.col("sharpe"), 5).alias("sharpe"), fix(F.col("max_drawdown"), 6).alias("max_drawdown"), F.col("trades").cast("long").alias("trades"))


@query(
    """SELECT strategy, parameters, (SELECT count(*) FROM (SELECT ticker FROM months GROUP BY ticker HAVING count(*) >= needed)) AS tickers FROM (VALUES ('buy_hold', '{}', 1), ('ma_cross', '{"fast": 3, "slow": 6}', 6),
    ('momentum', '{"lookback": 6, "top": 5, "holding": 1, "rebalance": "bar"}', 7), ('mean_reversion', '{"lookback": 6, "threshold": 1.0}', 6), ('pairs', '{"lookback": 6, "threshold": 1.0}', 6)) AS s(strategy, parameters, needed)"""
)
def bt_strategies(spark, sf_dir):
    """The list of strategies, and how many of the tickers each can run on."""
    return backtest.offered(views.months(spark, sf_dir))

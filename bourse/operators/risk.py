"""Risk of return series. Definitions of this library: simple returns, sample deviations, historical VaR as the continuous percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import series

#: Quantiles of the standard normal distribution for the usual confidences.
NORMAL_QUANTILES = {0.90: 1.2815515655446004, 0.95: 1.6448536269514722, 0.99: 2.3263478740408408}


def var_historical(ret: str, confidence: float, horizon: int = 1) -> Column:
    return F.percentile(ret, 1 - confidence) * float(horizon) ** 0.5


def var_parametric(ret: str, confidence: float, horizon: int = 1) -> Column:
    return (F.avg(ret) - NORMAL_QUANTILES[confidence] * F.stddev_samp(ret)) * float(horizon) ** 0.5


def var_monte_carlo(returns: DataFrame, confidence: float, paths: int = 10_000, seed: int = 7) -> DataFrame:
    """Percentile of normal draws with each ticker's moments."""
    moments = returns.groupBy("ticker").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sigma"))
    draws = moments.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths)))).withColumn("x", F.col("mu") + F.col("sigma") * F.randn(seed))
    return draws.groupBy("ticker").agg(F.percentile("x", 1 - confidence).alias("var"))


def expected_shortfall(returns: DataFrame, confidence: float) -> DataFrame:
    cut = returns.groupBy("ticker").agg(F.percentile("ret", 1 - confidence).alias("cut"))
    return returns.join(cut, "ticker").filter("ret <= cut").groupBy("ticker").agg(F.avg("ret").alias("es"))


def sharpe(ret: str, rf: float = 0.04, periods: int = 252) -> Column:
    return F.try_divide(F.avg(ret) * periods - rf, F.nullif(F.stddev_samp(ret), F.lit(0.0)) * float(periods) ** 0.5)


def sortino(ret: str, rf: float = 0.04, periods: int = 252) -> Column:
    below = F.least(F.col(ret) - rf / periods, F.lit(0.0))
    return F.try_divide(F.avg(ret) * periods - rf, F.nullif(F.sqrt(F.avg(below * below)), F.lit(0.0)) * float(periods) ** 0.5)


def with_benchmark(returns: DataFrame) -> DataFrame:
    """Each return with the mean of all tickers on its date."""
    market = returns.groupBy("date").agg(F.avg("ret").alias("market"))
    return returns.join(market, "date")


def against_market(ret: str = "ret", market: str = "market") -> dict[str, Column]:
    return {"beta": F.regr_slope(ret, market), "alpha": F.regr_intercept(ret, market), "correlation": F.corr(ret, market), "r2": F.regr_r2(ret, market)}


def max_drawdown(returns: DataFrame) -> DataFrame:
    curve = series.drawdown(series.equity(returns))
    return curve.groupBy("ticker").agg(F.min("drawdown").alias("max_drawdown"))


def bundle(returns: DataFrame, rf: float = 0.04, periods: int = 12, key: str = "ticker", market: DataFrame | None = None) -> DataFrame:
    """All figures of a ticker, or of another ``key``, in one pass over its windowed returns. ``market``: date, market; else the mean of ``returns``."""
    rows = with_benchmark(returns) if market is None else returns.join(market, "date")
    rows = series.drawdown(series.equity(rows, key), key)
    return rows.groupBy(key).agg(
        var_historical("ret", 0.95).alias("var_95"), var_historical("ret", 0.99).alias("var_99"), sharpe("ret", rf, periods).alias("sharpe"), sortino("ret", rf, periods).alias("sortino"),
        F.regr_slope("ret", "market").alias("beta"), F.regr_intercept("ret", "market").alias("alpha"), F.min("drawdown").alias("max_drawdown"),
        (F.stddev_samp("ret") * float(periods) ** 0.5).alias("volatility"), F.corr("ret", "market").alias("correlation"),
    )


def correlation_map(pairs: DataFrame) -> DataFrame:
    """Nested form: a ticker's correlations as a map."""
    entries = F.sort_array(F.collect_list(F.struct("b", "corr")))
    return pairs.groupBy("a").agg(F.map_from_entries(entries).alias("correlations"))


def zscore(rows: DataFrame, value: str, lookback: int, key: str = "ticker") -> Column:
    w = W.partitionBy(key).orderBy("date").rowsBetween(1 - lookback, 0)
    return F.when(F.count(value).over(w) == lookback, F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))))

"""Strategies over bars: positions from past closes, equity curves and their figures. A position earns the next bar's return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import RequestError
from . import risk, series

#: The strategies and their default parameters.
STRATEGIES = {
    "buy_hold": {}, "ma_cross": {"fast": 3, "slow": 6}, "momentum": {"lookback": 6, "top": 5, "holding": 1, "rebalance": "bar"},
    "mean_reversion": {"lookback": 6, "threshold": 1.0}, "pairs": {"lookback": 6, "threshold": 1.0},
}


MOST_LOST = 0.99


def _w(key: str = "ticker"):
    return W.partitionBy(key).orderBy("date")


def buy_hold(bars: DataFrame) -> DataFrame:
    return bars.withColumn("position", F.lit(1.0))


def ma_cross(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    rows = series.moving_average(series.moving_average(bars, fast, out="fast"), slow, out="slow")
    return rows.withColumn("position", F.when(F.col("fast") > F.col("slow"), 1.0).otherwise(0.0))


#: How often a strategy may rebalance.
REBALANCE = ("bar", "week", "month", "quarter", "year")


def momentum(bars: DataFrame, lookback: int, top: int, holding: int = 1, rebalance: str = "bar") -> DataFrame:
    """The ``top`` tickers by return over ``lookback`` bars, chosen on each rebalance date and held for ``holding`` bars.

    A rebalance date is the first date that any ticker has in each week, month, quarter or year, or every date for "bar".
    A holding that outlasts the next rebalance date ends there; between its end and that date a ticker has no position.
    """
    if rebalance not in REBALANCE:
        raise RequestError(f"unknown rebalance {rebalance}")
    rows = bars.withColumn("past", F.try_divide(F.col("close"), F.lag("close", lookback).over(_w())) - 1)
    rank = F.row_number().over(W.partitionBy("date").orderBy(F.col("past").desc_nulls_last(), "ticker"))
    chosen = F.when(F.col("past").isNotNull() & (rank <= top), 1.0).otherwise(0.0)
    if rebalance == "bar" and holding == 1:
        return rows.withColumn("position", chosen)
    period = F.col("date") if rebalance == "bar" else F.trunc("date", rebalance)
    firsts = bars.groupBy(period.alias("_period")).agg(F.min("date").alias("date")).select("date", F.lit(True).alias("_turn"))
    rows = rows.withColumn("_chosen", chosen).join(firsts, "date", "left").withColumn("_bar", F.row_number().over(_w()))
    upto = _w().rowsBetween(W.unboundedPreceding, 0)
    at = F.last(F.when(F.col("_turn"), F.struct("_bar", "_chosen")), True).over(upto)
    rows = rows.withColumn("_at", at).withColumn("position", F.when(F.col("_bar") - F.col("_at._bar") < holding, F.col("_at._chosen")).otherwise(0.0))
    return rows.drop("_chosen", "_turn", "_bar", "_at")


def mean_reversion(bars: DataFrame, lookback: int, threshold: float) -> DataFrame:
    z = risk.zscore(bars, "close", lookback)
    return bars.withColumn("z", z).withColumn("position", F.when(F.col("z") < -threshold, 1.0).when(F.col("z") > threshold, -1.0).otherwise(0.0))


def pairs(bars: DataFrame, a: str, b: str, lookback: int, threshold: float) -> DataFrame:
    """Spread of two tickers' closes, faded when it is far from its mean."""
    x = bars.filter(F.col("ticker") == a).select("date", F.col("close").alias("x"))
    y = bars.filter(F.col("ticker") == b).select("date", F.col("close").alias("y"))
    rows = x.join(y, "date").select("date", F.lit(f"{a}/{b}").alias("ticker"), (F.col("x") - F.col("y")).alias("close"))
    return mean_reversion(rows, lookback, threshold)


def earned(positions: DataFrame) -> DataFrame:
    """Return of each bar under the position taken at the bar before; a short position loses MOST_LOST at most."""
    rows = series.returns(positions)
    return rows.withColumn("strategy_ret", F.greatest(F.coalesce(F.lag("position").over(_w()) * F.col("ret"), F.lit(0.0)), F.lit(-MOST_LOST)))


def trades(positions: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Round trips: ticker, direction, entry_date, exit_date, entry_price, exit_price, quantity, cost, profit, is_open.

    A trade is a run of bars with one position other than 0. It is entered at the close of the run's first bar and left at
    that of the bar after the run; the last one, if no bar follows, is valued at the last close. Each has ``capital`` times its
    position to spend; a short one has a negative quantity.
    """
    at = F.coalesce("position", F.lit(0.0))
    rows = positions.select("ticker", "date", "close", at.alias("position"))
    turn = F.when(F.col("position") != F.coalesce(F.lag("position").over(_w()), F.lit(0.0)), 1).otherwise(0)
    runs = rows.withColumn("turn", turn).withColumn("run", F.sum("turn").over(_w().rowsBetween(W.unboundedPreceding, 0))).groupBy("ticker", "run").agg(
        F.first("position").alias("position"), F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_price"), F.max("date").alias("_last"), F.max_by("close", "date").alias("_close")
    )
    following = W.partitionBy("ticker").orderBy("run")
    runs = runs.withColumns({"_next": F.lead("entry_date").over(following), "_at": F.lead("entry_price").over(following)}).filter("position <> 0")
    out = runs.withColumns({"exit_date": F.coalesce("_next", "_last"), "exit_price": F.when(F.col("_next").isNull(), F.col("_close")).otherwise(F.col("_at")), "quantity": F.col("position") * capital / F.col("entry_price"), "is_open": F.col("_next").isNull()})
    out = out.withColumns({"direction": F.when(F.col("position") > 0, "long").otherwise("short"), "cost": F.abs("quantity") * F.col("entry_price"), "profit": F.col("quantity") * (F.col("exit_price") - F.col("entry_price"))})
    return out.select("ticker", "direction", "entry_date", "exit_date", "entry_price", "exit_price", "quantity", "cost", "profit", "is_open")


def trade_figures(done: DataFrame) -> DataFrame:
    """Of each ticker's trades: their count, how many gained, the win rate, mean win and mean loss."""
    gain = F.col("profit")
    won = F.sum(F.when(gain > 0, 1).otherwise(0))
    return done.groupBy("ticker").agg(F.count(F.lit(1)).alias("trades"), won.alias("profitable"), (won / F.count(F.lit(1))).alias("win_rate"), F.avg(F.when(gain > 0, gain)).alias("avg_win"), F.avg(F.when(gain < 0, gain)).alias("avg_loss"))


def figures(positions: DataFrame, capital: float = 10_000.0, periods: int = 12, rf: float = 0.04) -> DataFrame:
    """Final value, total and annualised return, drawdown, Sharpe and Sortino of each ticker's curve, and the figures of its trades."""
    rows = series.drawdown(series.equity(earned(positions), ret="strategy_ret", start=capital))
    out = rows.groupBy("ticker").agg(
        F.max_by("value", "date").alias("final_value"), F.count(F.lit(1)).alias("n"), F.min("drawdown").alias("max_drawdown"), risk.sharpe("strategy_ret", rf, periods).alias("sharpe"), risk.sortino("strategy_ret", rf, periods).alias("sortino"),
    )
    grown, none = F.col("final_value") / capital, F.lit(0).cast("long")
    out = out.join(trade_figures(trades(positions, capital)), "ticker", "left").withColumns({"trades": F.coalesce("trades", none), "profitable": F.coalesce("profitable", none)})
    return out.withColumns({"total_return": grown - 1, "annual_return": F.pow(grown, periods / F.col("n")) - 1})


def compare(bars: DataFrame) -> DataFrame:
    """Every strategy's mean figures over all tickers."""
    runs = {"buy_hold": buy_hold(bars), "ma_cross": ma_cross(bars, **STRATEGIES["ma_cross"]), "momentum": momentum(bars, **STRATEGIES["momentum"]), "mean_reversion": mean_reversion(bars, **STRATEGIES["mean_reversion"])}
    out = None
    for name, rows in runs.items():
        one = figures(rows).agg(F.lit(name).alias("strategy"), F.avg("total_return").alias("total_return"), F.avg("sharpe").alias("sharpe"), F.min("max_drawdown").alias("max_drawdown"), F.sum("trades").alias("trades"))
        out = one if out is None else out.unionByName(one)
    return out


def catalogue(spark) -> DataFrame:
    import json

    return spark.createDataFrame([(n, json.dumps(p)) for n, p in STRATEGIES.items()], "strategy string, parameters string")


#: Bars that a ticker needs before a strategy takes a position.
NEEDED = {"buy_hold": 1, "ma_cross": 6, "momentum": 7, "mean_reversion": 6, "pairs": 6}


def offered(bars: DataFrame) -> DataFrame:
    """The strategies with their parameters, and how many tickers have the bars that each needs."""
    names = list(STRATEGIES)
    need = F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(NEEDED[n]).alias("needed")) for n in names])
    counts = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.explode(need))
    tickers = counts.groupBy("x.strategy").agg(F.sum(F.when(F.col("n") >= F.col("x.needed"), 1).otherwise(0)).alias("tickers"))
    return catalogue(bars.sparkSession).join(tickers, "strategy", "left").withColumn("tickers", F.coalesce("tickers", F.lit(0)))

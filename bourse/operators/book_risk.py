"""Risk of portfolios: their return series as a product of weights and returns, and value at risk by three methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import portfolio, risk

#: Portfolios and tickers in a block of the product of weights and returns.
PORTFOLIOS, TICKERS = 1024, 256
#: Portfolios in a block of draws, and draws that a task makes at a time.
DRAWN, PATHS = 128, 1000


def _blocks(n: int, width: int) -> int:
    return max(1, -(-n // width))


def returns_of(weights: DataFrame, returns: DataFrame, key: str = "portfolio_id", portfolios: int = PORTFOLIOS, tickers: int = TICKERS) -> DataFrame:
    """Return of each portfolio on each date: the mean of its tickers' returns by weight, over those that have one: key, date, ret.

    ``weights``: key, ticker, weight. A dense product of a block of portfolios' weights and a block of tickers' returns runs in
    one task; a return is sent once for each block of portfolios, and what is shuffled then is a row for each portfolio, date
    and block of tickers. A date on which a portfolio's weights with a return sum to nothing has no row.
    """
    wanted = weights.filter(f"`{key}` IS NOT NULL AND ticker IS NOT NULL AND weight IS NOT NULL").select(F.col(key).cast("long").alias("k"), "ticker", F.col("weight").cast("double").alias("weight"))
    known = returns.filter("ticker IS NOT NULL AND date IS NOT NULL AND ret IS NOT NULL")
    n = _blocks(wanted.select("k").distinct().count(), portfolios)
    m = _blocks(known.select("ticker").distinct().count(), tickers)
    tb, every = F.pmod(F.xxhash64("ticker"), F.lit(m)).alias("tb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pb")
    left = wanted.select(F.pmod(F.xxhash64("k"), F.lit(n)).alias("pb"), tb, "k", "ticker", "weight")
    right = known.select(every, tb, "ticker", F.to_date("date").alias("date"), F.col("ret").cast("double").alias("ret"))

    def product(w, r):
        import numpy as np
        import pandas as pd

        r = r[r["ticker"].isin(w["ticker"].unique())]
        if not len(r):
            return pd.DataFrame({"k": np.zeros(0, np.int64), "date": np.zeros(0, object), "num": np.zeros(0), "den": np.zeros(0)})
        names, keys = pd.Index(r["ticker"].unique()), pd.Index(w["k"].unique())
        dates, codes = np.unique(r["date"].to_numpy(), return_inverse=True)
        x, has = np.zeros((len(names), len(dates))), np.zeros((len(names), len(dates)))
        at = names.get_indexer(r["ticker"])
        x[at, codes], has[at, codes] = r["ret"], 1.0
        w = w[w["ticker"].isin(names)]
        dense = np.zeros((len(keys), len(names)))
        np.add.at(dense, (keys.get_indexer(w["k"]), names.get_indexer(w["ticker"])), w["weight"])
        num, den, held = dense @ x, dense @ has, (dense != 0).astype(float) @ has > 0
        line, column = np.nonzero(held)
        return pd.DataFrame({"k": keys.to_numpy()[line], "date": dates[column], "num": num[line, column], "den": den[line, column]})

    parts = left.groupBy("pb", "tb").cogroup(right.groupBy("pb", "tb")).applyInPandas(product, "k long, date date, num double, den double")
    if m > 1:  # else a portfolio's date is in one product only
        parts = parts.groupBy("k", "date").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return parts.filter("den <> 0").select(F.col("k").alias(key), "date", (F.col("num") / F.col("den")).alias("ret"))


def value_at_risk(rets: DataFrame, values: DataFrame, confidence: float = 0.95, horizon: int = 1, method: str = "historical", key: str = "portfolio_id") -> DataFrame:
    """Value at risk of each portfolio as a return and an amount: key, portfolio_value, var_percentage, var_amount."""
    return values_at_risk(rets, values, confidence, horizon, (method,), key).drop("method")


def values_at_risk(rets: DataFrame, values: DataFrame, confidence: float = 0.95, horizon: int = 1, methods: tuple[str, ...] = ("historical", "parametric"), key: str = "portfolio_id") -> DataFrame:
    """The same by several methods, from one pass over the returns, with a row for each ``method``."""
    share = {"historical": risk.var_historical, "parametric": risk.var_parametric}
    found = rets.groupBy(key).agg(*[share[m]("ret", confidence, horizon).alias(m) for m in methods])
    shares = found.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("var")) for m in methods])).alias("x")).select(key, "x.*")
    return amounts(shares, values, key, "method")


def amounts(shares: DataFrame, values: DataFrame, key: str = "portfolio_id", *more: str) -> DataFrame:
    rows = shares.join(values.select(key, F.col("value").alias("portfolio_value")), key)
    return rows.select(key, *more, "portfolio_value", (100 * F.col("var")).alias("var_percentage"), (F.col("var") * F.col("portfolio_value")).alias("var_amount"))


def monte_carlo(weights: DataFrame, returns: DataFrame, confidence: float = 0.95, horizon: int = 1, paths: int = 10_000, seed: int = 7, key: str = "portfolio_id", known=None) -> DataFrame:
    """Percentile of joint normal draws of the tickers' returns, by the Cholesky factor of their covariances: key, var.

    The factor of at most MOST_ASSETS tickers (32 MB) is made in one place and broadcast. Every block of portfolios is drawn
    the same paths, from seeds of their own, so a portfolio's figure doesn't depend on the block it lies in.
    """
    import numpy as np

    names, mean, c = known or portfolio.moments(returns)
    c = c + 1e-12 * max(float(np.trace(c)) / len(c), 1e-300) * np.eye(len(c))
    shared = weights.sparkSession.sparkContext.broadcast((names, mean * horizon, np.linalg.cholesky(c) * float(horizon) ** 0.5))
    rows = weights.filter(f"`{key}` IS NOT NULL AND ticker IS NOT NULL AND weight IS NOT NULL").select(F.col(key).cast("long").alias("k"), "ticker", F.col("weight").cast("double").alias("weight"))
    n = _blocks(rows.select("k").distinct().count(), DRAWN)

    def draw(w):
        import numpy as np
        import pandas as pd

        names, mean, factor = shared.value
        place = pd.Index(names).get_indexer(w["ticker"])
        keys = pd.Index(w["k"].unique())
        dense = np.zeros((len(keys), len(names)))
        found = place >= 0
        np.add.at(dense, (keys.get_indexer(w["k"])[found], place[found]), w["weight"].to_numpy()[found])
        total = dense.sum(1)
        keys, dense = keys[total != 0], dense[total != 0] / total[total != 0, None]
        exposed = dense @ factor
        drawn = [exposed @ np.random.default_rng([seed, at]).standard_normal((len(names), min(PATHS, paths - at))) for at in range(0, paths, PATHS)]
        values = np.concatenate(drawn, 1) + (dense @ mean)[:, None]
        return pd.DataFrame({"k": keys, "var": np.quantile(values, 1 - confidence, axis=1)})

    out = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(n))).applyInPandas(draw, "k long, var double")
    return out.withColumnRenamed("k", key)

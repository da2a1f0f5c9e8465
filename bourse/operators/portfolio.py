"""Portfolios as bags of positions: algebra, holdings, valuation, weights and optimisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import AssetNotFoundError, DuplicateAssetError, EmptyPortfolioError, InvalidAssetTypeError, RequestError, UnsupportedOperationError
from ..functions.numeric import fix
from ..functions.symbols import portfolio_type
from ..schemas import ASSET_TYPES
from . import covariance


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union: duplicates add up."""
    return a.unionByName(b)


def counts(bag: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """How often a bag holds each value of ``keys``: keys, n.

    Keys are about as many as rows, so rows aren't counted in the tasks that make them, whose number is chosen by the bytes that they
    read, but in ``spark.sql.shuffle.partitions`` tasks; ``spread`` deals a frequent key's rows to several of them.
    """
    tasks = int(bag.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bag.repartition(tasks, *keys, spread).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def add_asset(positions: DataFrame, asset: dict, unique: bool = False) -> DataFrame:
    """One position more; a type that bags don't hold is an error, and with ``unique`` an asset that is there already."""
    if asset["asset_type"] not in (*ASSET_TYPES, "Forex"):
        raise InvalidAssetTypeError(asset["asset_type"])
    if unique and not positions.filter((F.col("asset_type") == ("FX" if asset["asset_type"] == "Forex" else asset["asset_type"])) & (F.col("asset_name") == asset["asset_name"])).isEmpty():
        raise DuplicateAssetError(asset["asset_name"])
    row = positions.sparkSession.createDataFrame([asset], positions.schema).withColumn("asset_type", portfolio_type(F.col("asset_type")))
    return positions.unionByName(row)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag difference: one occurrence goes for each listed asset; unknown ones are ignored."""
    return a.exceptAll(b.select(*a.columns))


def remove_asset(positions: DataFrame, asset_type: str, asset_name: str) -> DataFrame:
    """One occurrence less; an unknown type, an empty portfolio or an asset that isn't there is an error."""
    if asset_type not in ASSET_TYPES:
        raise InvalidAssetTypeError(asset_type)
    if positions.isEmpty():
        raise EmptyPortfolioError("nothing to remove")
    row = positions.filter((F.col("asset_type") == asset_type) & (F.col("asset_name") == asset_name)).limit(1)
    if row.isEmpty():
        raise AssetNotFoundError(asset_name)
    return positions.exceptAll(row)


def value_by_type(positions: DataFrame, value: str = "vw") -> DataFrame:
    """Sum of the values of each asset type; all types appear, empty ones with 0."""
    types = positions.sparkSession.createDataFrame([(t,) for t in ASSET_TYPES], "asset_type string")
    sums = positions.groupBy("asset_type").agg(F.sum(value).alias("value"))
    return types.join(sums, "asset_type", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def cash_balance(ledger: DataFrame, key: str = "portfolio_id") -> DataFrame:
    return ledger.groupBy(key).agg(F.sum("amount").alias("balance"))


#: Days in a chunk of a holding's transactions.
CHUNK_DAYS = 64


def basis(transactions: DataFrame, days: int = CHUNK_DAYS) -> DataFrame:
    """What each portfolio holds of each ticker after its transactions in order (date, seq): quantity, avg_cost, realised, oversold.

    A purchase moves the average cost, a sale leaves it and realises price less cost; a position that is closed has no cost,
    so the next purchase starts a new basis. A sale of more than is held sells what is held; the rest is counted in oversold.
    Without dates, all is of one day; without seq, a day's purchases come before its sales.

    A holding's transactions are dealt into chunks of days. A chunk needs the quantity at its start, which running sums and
    their least value give; its effect on average cost and realised profit is linear in the cost at its start, so the
    chunks' effects are composed in order: no task has more of a holding than a chunk, or a row for each of its chunks.
    """
    keys = ["portfolio_id", "ticker"]
    signed = F.when(F.col("transaction_type") == "sell", -F.col("quantity")).when(F.col("transaction_type") == "buy", F.col("quantity")).cast("double")
    at = {"date": F.lit(None).cast("date"), "seq": (F.col("transaction_type") == "sell").cast("int")} | {c: F.col(c) for c in ("date", "seq") if c in transactions.columns}
    rows = transactions.select(*keys, *[c.alias(n) for n, c in at.items()], signed.alias("d"), F.col("price").cast("double").alias("p")).filter("d IS NOT NULL").withColumn("chunk", F.floor(F.unix_date("date") / days))
    moves = F.transform(F.sort_array(F.collect_list(F.struct("date", "seq", "d", "p"))), lambda m: F.struct(m["d"].alias("d"), m["p"].alias("p")))
    chunks = rows.groupBy(*keys, "chunk").agg(moves.alias("moves"))  # what has put them in order isn't shuffled again
    zero = F.lit(0.0)
    run = F.aggregate("moves", F.struct(zero.alias("total"), zero.alias("least")), lambda s, m: F.struct((s["total"] + m["d"]).alias("total"), F.least(s["least"], s["total"] + m["d"]).alias("least")))
    before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("run", run).withColumn("sum0", F.coalesce(F.sum("run.total").over(before), zero))
    lowest = F.coalesce(F.min(F.col("sum0") + F.col("run.least")).over(before), zero)
    chunks = chunks.withColumn("held", F.col("sum0") - F.least(lowest, zero))
    # cost = scale * (cost at the start) + own; realised = gain + slope * (cost at the start)
    names = ("held", "scale", "own", "gain", "slope", "oversold")
    state = lambda *values: F.struct(*[v.alias(n) for n, v in zip(names, values)])

    def step(s, m):
        d, sold = m["d"], F.least(-m["d"], s["held"])
        after, left = s["held"] + d, s["held"] - sold
        bought = state(after, s["scale"] * s["held"] / after, (s["own"] * s["held"] + d * m["p"]) / after, s["gain"], s["slope"], s["oversold"])
        kept = lambda c: F.when(left > 0, s[c]).otherwise(zero)
        gone = state(left, kept("scale"), kept("own"), s["gain"] + sold * (m["p"] - s["own"]), s["slope"] - sold * s["scale"], s["oversold"] - d - sold)
        return F.when(d > 0, bought).when(d < 0, gone).otherwise(s)

    effect = F.aggregate("moves", state(F.col("held"), F.lit(1.0), zero, zero, zero, zero), step)
    effects = chunks.select(*keys, "chunk", effect.alias("e")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk", "e"))).alias("effects"))
    start = F.struct(zero.alias("cost"), zero.alias("realised"), zero.alias("oversold"))
    whole = F.aggregate("effects", start, lambda s, x: F.struct((x["e"]["scale"] * s["cost"] + x["e"]["own"]).alias("cost"), (s["realised"] + x["e"]["gain"] + x["e"]["slope"] * s["cost"]).alias("realised"), (s["oversold"] + x["e"]["oversold"]).alias("oversold")))
    out = effects.select(*keys, F.element_at("effects", -1)["e"]["held"].cast("long").alias("quantity"), whole.alias("w"))
    return out.select(*keys, "quantity", fix(F.col("w.cost"), 4).alias("avg_cost"), fix(F.col("w.realised"), 4).alias("realised"), F.col("w.oversold").cast("long").alias("oversold"))


def holdings_of(transactions: DataFrame) -> DataFrame:
    """What each portfolio still holds of each ticker, at its average cost since it was last bought from nothing; nothing held, no row."""
    return basis(transactions).filter("quantity > 0").select("portfolio_id", "ticker", "quantity", "avg_cost")


def valued(holdings: DataFrame, latest: DataFrame) -> DataFrame:
    """Holdings at the latest close: value, profit, profit in percent, and weight in the portfolio in percent."""
    rows = holdings.join(latest.select("ticker", F.col("close").alias("current_price")), "ticker")
    rows = rows.withColumns({"value": F.col("quantity") * F.col("current_price"), "pnl": F.col("quantity") * (F.col("current_price") - F.col("avg_cost"))})
    whole = F.sum("value").over(W.partitionBy("portfolio_id"))
    return rows.withColumns({"pnl_pct": 100 * F.try_divide(F.col("current_price") - F.col("avg_cost"), F.col("avg_cost")), "weight_pct": 100 * F.try_divide(F.col("value"), whole)})


def as_of_prices(rows: DataFrame, bars: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Each row with the last close at or before its date (null: none), without a range join.

    The window runs over the bars and the distinct dates asked for, as many as an instrument has days; the
    rows themselves are joined by instrument and date, where a busy instrument's rows can be split.
    """
    quotes = bars.select(F.col(key).alias("_k"), F.col("date").alias("_d"), F.lit(0).alias("_o"), F.col("close").cast("double").alias("_c"))
    asks = rows.select(F.col(key).alias("_k"), F.col(date).alias("_d")).distinct().select("_k", "_d", F.lit(1).alias("_o"), F.lit(None).cast("double").alias("_c"))
    w = W.partitionBy("_k").orderBy("_d", "_o").rowsBetween(W.unboundedPreceding, 0)
    known = quotes.unionByName(asks).withColumn("as_of_close", F.last("_c", True).over(w)).filter("_o = 1").select("_k", "_d", "as_of_close")
    return rows.join(known, (F.col(key) == F.col("_k")) & (F.col(date) == F.col("_d")), "left").select(*rows.columns, "as_of_close")


def performance(portfolios: DataFrame) -> DataFrame:
    gain = F.col("total_value") - F.col("initial_capital")
    return portfolios.withColumns({"profit_loss": gain, "return_pct": 100 * F.try_divide(gain, F.col("initial_capital"))})


def weights_of(additions: DataFrame) -> DataFrame:
    """The weight of each ticker; a later addition overrides an earlier one."""
    return additions.groupBy("ticker").agg(F.max_by("weight", "add_seq").alias("weight"))


def expected_return(weights: DataFrame, returns: DataFrame) -> DataFrame:
    mean = returns.groupBy("ticker").agg(F.avg("ret").alias("mu"))
    return weights.join(mean, "ticker").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"))


def volatility(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Square root of w'Cw; each unordered pair stands for both."""
    w = lambda c: weights.select(F.col("ticker").alias(c), F.col("weight").alias(f"w_{c}"))
    pairs = covariance.upper(returns).join(w("a"), "a").join(w("b"), "b")
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    return pairs.agg(F.sqrt(F.sum(twice * F.col("w_a") * F.col("w_b") * F.col("cov"))).alias("volatility"))


def contributions(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Each ticker's share of the portfolio's variance, w_i (Cw)_i / w'Cw: ticker, weight, contribution."""
    w = lambda c: weights.select(F.col("ticker").alias(c), F.col("weight").alias(f"w_{c}"))
    parts = covariance.mirrored(covariance.upper(returns)).join(w("a"), "a").join(w("b"), "b").groupBy("a", "w_a").agg((F.col("w_a") * F.sum(F.col("w_b") * F.col("cov"))).alias("part"))
    whole = parts.agg(F.sum("part").alias("whole"))  # one row
    return parts.join(F.broadcast(whole)).select(F.col("a").alias("ticker"), F.col("w_a").alias("weight"), F.try_divide("part", "whole").alias("contribution"))


OPTIMISERS = ("min_variance", "max_sharpe", "mean_variance", "risk_parity")
#: Tickers that an optimisation takes at most: their covariances are solved in one place.
MOST_ASSETS = 2_000


def moments(returns: DataFrame) -> tuple[list[str], "np.ndarray", "np.ndarray"]:  # noqa: F821
    """Tickers, mean returns and covariances: Spark aggregates, of at most MOST_ASSETS tickers."""
    import numpy as np

    mean = returns.groupBy("ticker").agg(F.avg("ret").alias("mu")).orderBy("ticker").limit(MOST_ASSETS + 1).collect()
    if not mean:
        raise EmptyPortfolioError("no returns")
    if len(mean) > MOST_ASSETS:
        raise UnsupportedOperationError(f"more than {MOST_ASSETS} tickers")
    names = [r["ticker"] for r in mean]
    place = {t: i for i, t in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for r in covariance.upper(returns).select("a", "b", "cov").collect():
        c[place[r["a"]], place[r["b"]]] = c[place[r["b"]], place[r["a"]]] = r["cov"] or 0.0
    return names, np.array([r["mu"] for r in mean]), c


def risk_parity(c, least: float = 0.0, most: float = 1.0):
    """Positive weights that sum to 1 of least log(w'Cw) / 2 - sum(log w) / n within the bounds.

    Without bounds that hold, every w_i (Cw)_i is the same: equal contributions to risk. In y, of any sum, with w = y / sum(y),
    the problem is convex: y'Cy / 2 - sum(log y) / n over the cone least * sum(y) <= y <= most * sum(y). Newton's method with
    damped steps solves it, behind a logarithmic barrier for the bounds that is lowered by steps. Directions without
    risk are held by a trillionth of the mean variance.
    """
    import numpy as np

    n = len(c)
    if n * most - 1 < 1e-12 or 1 - n * least < 1e-12:
        return np.full(n, 1 / n)
    scale = max(float(np.trace(c)) / n, 1e-300)
    c = c / scale + 1e-12 * np.eye(n)
    sides = ([(1.0, least)] if least > 0 else []) + ([(-1.0, most)] if most < 1 else [])
    y = np.full(n, 1.0)
    y /= np.sqrt(max(y @ c @ y, 1e-12))
    #: The barrier's share of the objective: 0 at once without bounds.
    for share in [10.0**-k for k in range(1, 14)] if sides else [0.0]:

        def value(y):
            slack = [s * (y - bound * y.sum()) for s, bound in sides]
            if y.min() <= 0 or any(x.min() <= 0 for x in slack):
                return np.inf
            return y @ c @ y / 2 - np.log(y).mean() - share * sum(np.log(x).sum() for x in slack)

        for _ in range(200):
            gradient, curve = c @ y - 1 / (n * y), c + np.diag(1 / (n * y * y))
            for s, bound in sides:  # slack = A y, with A = s (I - bound 11')
                x = s * (y - bound * y.sum())
                turn = lambda v: s * (v - bound * v.sum())  # noqa: B023, E731
                gradient = gradient - share * turn(1 / x)
                square = np.diag(1 / (x * x))
                square = square - bound * (square.sum(0)[None, :] + square.sum(1)[:, None]) + bound * bound * square.sum()
                curve = curve + share * square
            move = np.linalg.solve(curve, -gradient)
            fall = -gradient @ move
            if fall < 1e-26:
                break
            step, here = 1.0, value(y)
            while step > 1e-12 and not value(y + step * move) <= here - 1e-4 * step * fall + 1e-15 * abs(here):
                step /= 2
            if step <= 1e-12:
                break
            y = y + step * move
    return y / y.sum()


def quadratic(c, m, least: float, most: float):
    """Weights of least w'Cw / 2 - m'w that sum to 1 within the bounds, by active sets.

    From equal weights on: the weights that aren't at a bound go to their optimum, or as far as the first bound; at the
    optimum, the bound that holds back the most is let go, until none holds back anything.
    """
    import numpy as np

    n = len(m)
    w, side = np.full(n, 1 / n), np.zeros(n, int)
    for _ in range(100 * n + 100):
        free = side == 0
        k = int(free.sum())
        if k:
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = c[np.ix_(free, free)], 1, 1
            right = np.append(m[free] - c[np.ix_(free, ~free)] @ w[~free], 1 - w[~free].sum())
            try:
                x = np.linalg.solve(system, right)
            except np.linalg.LinAlgError:  # singular covariances
                x = np.linalg.lstsq(system, right, rcond=None)[0]
            move, price = np.zeros(n), x[k]
            move[free] = x[:k] - w[free]
            room = np.where(move < 0, least - w, most - w)
            share = np.where(np.abs(move) > 1e-15, room / np.where(move == 0, 1, move), np.inf)
            i = int(np.argmin(share))
            w = w + min(1.0, share[i]) * move
            if share[i] < 1:
                side[i] = -1 if move[i] < 0 else 1
                w[i] = least if move[i] < 0 else most
                continue
        else:
            gain = m - c @ w
            price = (gain[side < 0].max(initial=-np.inf) + gain[side > 0].min(initial=np.inf)) / 2 if (side < 0).any() and (side > 0).any() else gain[side < 0].max() if (side < 0).any() else gain.min()
        held = -side * (m - c @ w - price)
        i = int(np.argmax(np.where(side == 0, -np.inf, held)))
        if side[i] == 0 or held[i] <= 1e-10 * max(1.0, float(np.abs(m).max())):
            break
        side[i] = 0
        if not k:  # another one must give what this one takes
            side[int(np.argmax(np.where(side == 0, -np.inf, held)))] = 0
    return w


def optimise(returns: DataFrame, kind: str = "max_sharpe", rf: float = 0.0, aversion: float = 3.0, least: float = -1e9, most: float = 1e9, target_return: float | None = None, known=None) -> DataFrame:
    """Weights that sum to 1. Only the N x N problem of the chosen tickers is solved in one place; ``known``: their moments, if at hand.

    Without bounds and target the solutions are closed forms, with the pseudo-inverse of a singular matrix. Within bounds
    they are optima of the bounded problem: min_variance and mean_variance (w'mu - aversion / 2 * w'Cw) as quadratic
    programs, max_sharpe as the best point of the efficient frontier. ``target_return``: the frontier's point with that
    mean return (min_variance and mean_variance). risk_parity gives equal contributions to risk, or comes as near as bounds allow.
    """
    import numpy as np

    if kind not in OPTIMISERS:
        raise ValueError(kind)
    names, mean, c = known or moments(returns)
    if not least * len(names) <= 1 <= most * len(names):
        raise RequestError("no weights within the bounds sum to 1")
    mu, one = mean - rf, np.ones(len(names))
    bounded = least > -1e9 or most < 1e9
    frontier = lambda a: quadratic(c, mean / a, least, most)
    if kind == "risk_parity":
        w = risk_parity(c, least, most)
    elif target_return is not None and kind != "max_sharpe":
        low, high = -20.0, 40.0  # of the logarithm of the aversion, in which the frontier's mean return falls
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if frontier(np.exp(middle)) @ mean > target_return else (low, middle)
        w = frontier(np.exp((low + high) / 2))
        if w @ mean < target_return - 1e-6:
            raise RequestError("no weights within the bounds have the target return")
    elif bounded and kind == "max_sharpe":
        sharpe = lambda a: (lambda w: (w @ mu) / max(np.sqrt(w @ c @ w), 1e-300))(frontier(np.exp(a)))
        grid = np.linspace(-15.0, 25.0, 161)  # the ratio is level where the bounds hold the weights, so the peak is bracketed first
        best = int(np.argmax([sharpe(x) for x in grid]))
        low, high, golden = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], (5**0.5 - 1) / 2
        for _ in range(50):
            x, y = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, y) if sharpe(x) >= sharpe(y) else (x, high)
        w = frontier(np.exp((low + high) / 2))
    elif bounded:
        w = quadratic(c, 0 * mu, least, most) if kind == "min_variance" else quadratic(c, mu / aversion, least, most)
    else:
        inverse = np.linalg.pinv(c)
        base = inverse @ one / (one @ inverse @ one)
        w = {"min_variance": base, "max_sharpe": inverse @ mu, "mean_variance": base + (inverse @ mu - (one @ inverse @ mu) * base) / aversion}[kind]
        w = w / w.sum()
    return returns.sparkSession.createDataFrame([(t, float(x)) for t, x in zip(names, w)], "ticker string, weight double")


def replay_orders(orders: DataFrame, cash: float) -> DataFrame:
    """Buys and sells in order, refused when cash or position is short: account, seq, ticker, side, quantity, price, accepted,
    cash (after it), position (of its ticker).

    Whether an order is accepted depends on all before it, so an account's orders pass through one task in order, batch by
    batch; that task holds the account's open positions, not its orders. An order without quantity or price is refused; one without account is in an account of its own.
    """
    import pyarrow as pa

    schema = pa.schema([("account", pa.int64()), ("seq", pa.int64()), ("ticker", pa.string()), ("side", pa.string()), ("quantity", pa.int64()), ("price", pa.float64()), ("accepted", pa.bool_()), ("cash", pa.float64()), ("position", pa.int64())])
    given = "account long, seq long, ticker string, side string, quantity long, price double"

    def run(stream):
        account, money, held, begun = None, cash, {}, False
        for batch in stream:
            accepted, moneys, positions = [], [], []
            accounts, tickers, sides, quantities, prices = (batch.column(c).to_pylist() for c in ("account", "ticker", "side", "quantity", "price"))
            for own, ticker, side, quantity, price in zip(accounts, tickers, sides, quantities, prices):
                if own != account or not begun:
                    account, money, held, begun = own, cash, {}, True
                has = held.get(ticker, 0)
                if quantity is None or price is None:
                    ok = False
                elif side == "buy":
                    if ok := quantity * price <= money:
                        money -= quantity * price
                        held[ticker] = has = has + quantity
                elif ok := has >= quantity:
                    money += quantity * price
                    has -= quantity
                    if has:
                        held[ticker] = has
                    else:
                        held.pop(ticker, None)
                accepted.append(ok)
                moneys.append(money)
                positions.append(has)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(moneys, pa.float64()), pa.array(positions, pa.int64())], schema=schema)

    rows = orders.select(*[F.col(name).cast(kind) for name, kind in map(str.split, given.split(", "))])
    return rows.repartition("account").sortWithinPartitions("account", "seq").mapInArrow(run, f"{given}, accepted boolean, cash double, position long")

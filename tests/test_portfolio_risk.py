"""Covariances by blocks, risk parity, cost basis, trades and the risk of portfolios against independent computations."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bourse.functions.numeric import fix
from bourse.operators import backtest, book_risk, covariance, portfolio
from bourse.sources import views


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(n)


def returns_frame(spark, wide):
    """Returns from a dates x tickers array, NaN where there is none."""
    rows = [(f"T{j:03d}", day(3 * i), float(x)) for i, line in enumerate(wide) for j, x in enumerate(line) if not np.isnan(x)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double")


@pytest.mark.parametrize("width, days", [(256, 2048), (3, 20), (1, 7)])
def test_covariances(spark, width, days):
    rng = np.random.default_rng(1)
    wide = 5 + rng.normal(size=(40, 8)) * 1e-3
    wide[rng.random(wide.shape) < 0.3] = np.nan
    wide[:, 7] = np.nan
    wide[4, 7] = 0.5  # one date only
    got = {(r.a, r.b): r for r in covariance.upper(returns_frame(spark, wide), width, days).collect()}
    frame = pd.DataFrame(wide, columns=[f"T{j:03d}" for j in range(8)])
    cov, corr, seen = frame.cov(), frame.corr(), frame.notna().astype(int)
    n = seen.T @ seen
    assert set(got) == {(a, b) for a in frame for b in frame if a <= b and n.loc[a, b] > 0}
    for (a, b), r in got.items():
        assert r.n == n.loc[a, b]
        assert (r.cov is None and r.corr is None) if r.n < 2 else r.cov == pytest.approx(cov.loc[a, b], rel=1e-9) and r.corr == pytest.approx(corr.loc[a, b], rel=1e-9)
    assert covariance.mirrored(covariance.upper(returns_frame(spark, wide), width, days)).count() == sum(1 if a == b else 2 for a, b in got)


def test_covariances_of_many_tickers(spark):
    wide = np.random.default_rng(2).normal(size=(30, 500))
    got = covariance.upper(returns_frame(spark, wide), 128).toPandas()
    assert len(got) == 500 * 501 // 2
    dense = np.cov(wide.T)
    at, to = got["a"].str[1:].astype(int), got["b"].str[1:].astype(int)
    assert np.abs(dense[at, to] - got["cov"]).max() < 1e-12
    assert covariance.upper(returns_frame(spark, wide[:0])).count() == 0


def test_risk_parity():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        a = rng.normal(size=(n, int(rng.integers(n, 2 * n + 2))))
        c = a @ a.T * 10.0 ** rng.integers(-6, 3)  # negative entries, some nearly singular
        w = portfolio.risk_parity(c)
        assert w.min() > 0 and abs(w.sum() - 1) < 1e-12 and np.abs(w * (c @ w) / (w @ c @ w) - 1 / n).max() < 1e-6


def test_risk_parity_within_bounds():
    """The Karush-Kuhn-Tucker conditions of log(w'Cw) / 2 - sum(log w) / n, and no better point among many."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(3, 20))
        a = rng.normal(size=(n, n + 3))
        c = a @ a.T
        low, high = rng.uniform(0, 0.9 / n), rng.uniform(1.1 / n, 2.5 / n)
        w = portfolio.risk_parity(c, low, high)
        assert abs(w.sum() - 1) < 1e-12 and w.min() >= low - 1e-12 and w.max() <= high + 1e-12
        slope = c @ w / (w @ c @ w) - 1 / (n * w)
        at_low, at_high = w < low + 1e-7, w > high - 1e-7
        free = ~at_low & ~at_high
        if free.any():
            price = slope[free].mean()
            assert np.abs(slope[free] - price).max() < 1e-6 and (slope[at_low] >= price - 1e-6).all() and (slope[at_high] <= price + 1e-6).all()
        value = lambda x: np.log(x @ c @ x) / 2 - np.log(x).mean()  # noqa: B023, E731
        for _ in range(200):
            i, j = rng.choice(n, 2, replace=False)
            other = w.copy()
            other[i], other[j] = w[i] + (t := rng.uniform(0, max(0.0, min(high - w[i], w[j] - low)))), w[j] - t
            assert other.min() <= 0 or value(w) <= value(other) + 1e-9
    assert portfolio.risk_parity(np.eye(4), 0.25, 1.0).tolist() == [0.25] * 4


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_contributions_are_equal(spark, size):
    rets = views.returns(spark, f"/root/testdata/{size}")
    rows = portfolio.contributions(portfolio.optimise(rets, "risk_parity"), rets).collect()
    assert len(rows) == 25 and all(r.contribution == pytest.approx(0.04, abs=1e-6) for r in rows)


def transactions(spark, rows):
    return spark.createDataFrame([("A" if len(r) < 5 else r[4], 1, r[0], r[1], r[2], day(r[3]), i) for i, r in enumerate(rows)], "ticker string, portfolio_id long, transaction_type string, quantity long, price double, date date, seq long")


def brute_basis(rows):
    held, cost, realised, over = 0, 0.0, 0.0, 0
    for kind, quantity, price, *_ in rows:
        if kind == "buy":
            cost = (held * cost + quantity * price) / (held + quantity)
            held += quantity
        else:
            sold = min(held, quantity)
            realised, over, held = realised + sold * (price - cost), over + quantity - sold, held - sold
            cost = cost if held else 0.0
    return held, cost, realised, over


@pytest.mark.parametrize("days", [64, 1, 5])
def test_basis(spark, days):
    rng = random.Random(days)
    closed = [("buy", 10, 1.0, 0), ("sell", 10, 2.0, 5), ("buy", 10, 5.0, 9)]
    early = [("sell", 5, 1.0, 0), ("buy", 4, 3.0, 0), ("sell", 6, 4.0, 1), ("buy", 2, 7.0, 1)]
    long = [(rng.choice(["buy", "buy", "sell"]), rng.randrange(1, 30), rng.randrange(100, 900) / 100, i // 3) for i in range(300)]
    for rows in (closed, early, long):
        r = portfolio.basis(transactions(spark, rows), days).first()
        held, cost, realised, over = brute_basis(rows)
        assert (r.quantity, r.oversold) == (held, over) and r.avg_cost == pytest.approx(cost, abs=6e-5) and r.realised == pytest.approx(realised, abs=6e-5)
    assert portfolio.holdings_of(transactions(spark, closed)).first().avg_cost == 5.0
    assert portfolio.basis(transactions(spark, [])).count() == 0
    assert portfolio.holdings_of(transactions(spark, closed[:2])).count() == 0


def test_trades(spark):
    closes, at = [10.0, 20.0, 16.0, 8.0, 10.0, 12.0], [1.0, 1.0, 0.0, -0.5, -0.5, 1.0]
    rows = spark.createDataFrame([("A", day(i), c, p) for i, (c, p) in enumerate(zip(closes, at))] + [("B", day(0), 5.0, 0.0)], "ticker string, date date, close double, position double")
    got = backtest.trades(rows).orderBy("entry_date").collect()
    assert [(r.direction, r.entry_date, r.exit_date, r.entry_price, r.exit_price, r.is_open) for r in got] == [
        ("long", day(0), day(2), 10.0, 16.0, False), ("short", day(3), day(5), 8.0, 12.0, False), ("long", day(5), day(5), 12.0, 12.0, True),
    ]
    assert [r.quantity for r in got] == pytest.approx([1000, -625, 10_000 / 12]) and [r.profit for r in got] == pytest.approx([6000, -2500, 0]) and [r.cost for r in got] == pytest.approx([10_000, 5000, 10_000])
    figures = {r.ticker: r for r in backtest.figures(rows).collect()}
    assert (figures["A"].trades, figures["A"].profitable, figures["A"].win_rate, figures["A"].avg_win, figures["A"].avg_loss) == pytest.approx((3, 1, 1 / 3, 6000, -2500))
    assert (figures["B"].trades, figures["B"].profitable, figures["B"].win_rate) == (0, 0, None)


def book(spark, rng, n_portfolios, n_tickers):
    return [(p, f"T{t:03d}", float(rng.integers(1, 50))) for p in range(n_portfolios) for t in rng.choice(n_tickers, int(rng.integers(1, n_tickers + 1)), replace=False)]


def test_portfolio_returns(spark):
    rng = np.random.default_rng(6)
    wide = rng.normal(size=(20, 9)) / 10
    wide[rng.random(wide.shape) < 0.2] = np.nan
    held = book(spark, rng, 30, 9) + [(77, "unknown", 1.0)]
    weights = spark.createDataFrame(held, "portfolio_id long, ticker string, weight double")
    want = {}
    for i, line in enumerate(wide):
        for p in range(30):
            own = [(w, line[int(t[1:])]) for k, t, w in held if k == p and not np.isnan(line[int(t[1:])])]
            if own:
                want[p, day(3 * i)] = sum(w * r for w, r in own) / sum(w for w, _ in own)
    for blocks in ((1024, 256), (4, 2)):
        got = {(r.portfolio_id, r.date): r.ret for r in book_risk.returns_of(weights, returns_frame(spark, wide), portfolios=blocks[0], tickers=blocks[1]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_monte_carlo_is_near_the_closed_form(spark, monkeypatch):
    rng = np.random.default_rng(8)
    wide = 0.01 + rng.normal(size=(200, 4)) @ rng.normal(size=(4, 6)) / 20
    held, rets = book(spark, rng, 12, 6), returns_frame(spark, wide)
    weights = spark.createDataFrame(held, "portfolio_id long, ticker string, weight double")
    got = {r.portfolio_id: r["var"] for r in book_risk.monte_carlo(weights, rets, 0.95, horizon=4, paths=40_000).collect()}
    monkeypatch.setattr(book_risk, "DRAWN", 3)
    again = {r.portfolio_id: r["var"] for r in book_risk.monte_carlo(weights, rets, 0.95, horizon=4, paths=40_000).collect()}
    mean, cov = wide.mean(0), np.cov(wide.T)
    for p in range(12):
        w = np.zeros(6)
        for k, t, x in held:
            if k == p:
                w[int(t[1:])] = x
        w /= w.sum()
        sd = np.sqrt(4 * w @ cov @ w)
        assert got[p] == pytest.approx(4 * w @ mean - 1.6448536269514722 * sd, abs=0.03 * sd) and again[p] == pytest.approx(got[p])


def test_value_at_risk(spark):
    rets = spark.createDataFrame([(1, day(i), x / 100) for i, x in enumerate([1, -2, 3, -4, 5])], "portfolio_id long, date date, ret double")
    values = spark.createDataFrame([(1, 200.0)], "portfolio_id long, value double")
    r = book_risk.value_at_risk(rets, values, 0.95, 4).select(fix(F.col("var_percentage"), 6).alias("p"), fix(F.col("var_amount"), 6).alias("a")).first()
    assert (r.p, r.a) == pytest.approx((-7.2, -14.4))


def test_series_are_made_where_they_are_read(spark, sf_dir, monkeypatch):
    """The portfolios' series aren't written for plans that read them once, and aren't made for the draws, which don't read them."""
    from bourse.plans import registry
    from bourse.plans import risk as plans

    made, kept, returns_of, staged = [], [], book_risk.returns_of, plans.staged
    monkeypatch.setattr(book_risk, "returns_of", lambda *a, **k: made.append(1) or returns_of(*a, **k))
    monkeypatch.setattr(plans, "staged", lambda df, name: kept.append(name) or staged(df, name))
    for name, times in (("portfolio_var_monte_carlo", 0), ("portfolio_var", 1), ("portfolio_returns", 1)):
        made.clear()
        kept.clear()
        registry.QUERIES[name](spark, sf_dir)
        assert len(made) == times and kept == ["held", "returns"], name


def test_series_of_one_block_of_tickers_are_not_summed_again(spark):
    rng = np.random.default_rng(3)
    weights = spark.createDataFrame(book(spark, rng, 5, 4), "portfolio_id long, ticker string, weight double")
    plan = lambda tickers: book_risk.returns_of(weights, returns_frame(spark, rng.normal(size=(6, 4))), tickers=tickers)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(256) and "Aggregate" in plan(2)


def test_moves_are_shuffled_without_what_orders_them(spark):
    ddl = "portfolio_id long, ticker string, transaction_type string, quantity long, price double, date date, seq long"
    plan = portfolio.basis(spark.createDataFrame([], ddl))._jdf.queryExecution().optimizedPlan()

    def nodes(at):
        yield at
        for i in range(at.children().size()):
            yield from nodes(at.children().apply(i))

    windows = [n for n in nodes(plan) if n.nodeName() == "Window"]
    moves = [a.dataType().simpleString() for n in windows for a in map(n.output().apply, range(n.output().size())) if a.name() == "moves"]
    assert moves and all(kind == "array<struct<d:double,p:double>>" for kind in moves)


def test_counts_of_bags_are_dealt_before_they_are_made(spark):
    """A hash map of all the keys that a task of the join makes isn't held there: rows are dealt to a fixed number of tasks first."""
    bag = spark.createDataFrame([(i % 5, "AB"[i % 2], i % 7) for i in range(70)] + [(None, "A", 1)] * 2, "portfolio_id long, ticker string, quantity long")
    got = portfolio.counts(bag, ["portfolio_id", "ticker"], "quantity")
    assert {(r.portfolio_id, r.ticker): r.n for r in got.collect()} == {(k, t): 7 for k in range(5) for t in "AB"} | {(None, "A"): 2}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.rindex("REPARTITION_BY_NUM") > plan.rindex("partial_count")

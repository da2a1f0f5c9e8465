import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from bourse.plans import registry
from bourse.sources import views


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name])


def test_runs(spark, sf_dir):
    """The queries without a SQL twin, executed: what holds of their rows whatever the solver or the draws."""
    without = {"optimised_weights", "portfolio_var_monte_carlo", "synthetic_candles", "var_monte_carlo"}
    assert set(registry.QUERIES) - set(registry.ORACLES) == without
    got = {name: registry.QUERIES[name](spark, sf_dir).collect() for name in without}
    kinds = {}
    for r in got["optimised_weights"]:
        kinds.setdefault(r.kind, []).append(r.weight)
    assert len(kinds) == 4 and all(sum(w) == pytest.approx(1) and min(w) >= -1e-9 and max(w) <= 0.5 + 1e-9 for w in kinds.values())
    candles, start = sorted(got["synthetic_candles"], key=lambda r: (r.ticker, r.id)), {r.ticker: r.close for r in views.latest(spark, sf_dir).collect()}
    assert len(candles) == 50 * len(start) and all(a.close == pytest.approx(b.open) for a, b in zip(candles, candles[1:]) if a.ticker == b.ticker)
    assert all(r.open == pytest.approx(start[r.ticker]) for r in candles if r.id == 0)
    assert all(r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high for r in candles)
    assert got["portfolio_var_monte_carlo"] and all(r.var_amount == pytest.approx(r.var_percentage / 100 * r.portfolio_value) for r in got["portfolio_var_monte_carlo"])
    moments = {r.ticker: (r.mu, r.sd) for r in views.returns(spark, sf_dir).groupBy("ticker").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd")).collect()}
    for r in got["var_monte_carlo"]:
        mu, sd = moments[r.ticker]
        assert r["var"] == pytest.approx(mu - 1.6448536269514722 * sd, abs=0.08 * sd)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

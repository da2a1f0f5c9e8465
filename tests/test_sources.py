"""Sources, sinks and the store: round trips, requests, configuration, errors, kinds of asset."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bourse import errors, schemas
from bourse.operators import board, orderflow, portfolio
from bourse.sources import files, shared, store


def test_rows_and_envelopes_as_json(spark):
    rows = spark.createDataFrame([(2, "b"), (1, None)], "id long, name string")
    assert sorted(r.json for r in files.to_json_rows(rows).collect()) == ['{"id":1}', '{"id":2,"name":"b"}']
    assert json.loads(files.to_envelope(rows).first().json) == {"results": [{"id": 1}, {"id": 2, "name": "b"}], "count": 2}


def test_lines_and_restore(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,\n1,2,3\n")
    assert [r.fields for r in files.read_lines(spark, str(tmp_path / "x.csv")).collect()] == [["a", "b"], ["1", "2", "3"]]
    some = spark.createDataFrame([(1,)], "id long")
    assert files.restore_if_empty(some.limit(0), lambda: some).count() == 1 and files.restore_if_empty(some, lambda: None) is some


def test_board_files(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"name": "A", "price": 1.5, "change": -2}, {"name": "B", "price": 3}]')
    (tmp_path / "lines.json").write_text('{"name": "C", "price": 2, "change": 0.5}\n\n{"name": "D"}\n')
    got = {r.name: (r.price, r.change) for r in files.read_board(spark, str(tmp_path)).collect()}
    assert got == {"A": (1.5, -2.0), "B": (3.0, None), "C": (2.0, 0.5), "D": (None, None)}


def test_requests_have_a_default_window():
    ask = files.BarsRequest("AAPL", today="2024-03-05")
    assert (ask.start, ask.end) == ("2024-02-24", "2024-03-05")
    assert files.BarsRequest("AAPL").path().startswith("/v2/aggs/ticker/AAPL/range/1/day/")
    for bad in ({"asset": ""}, {"asset": "A", "span": "eon"}, {"asset": "A", "start": "2025-01-01", "end": "2024-01-01"}, {"asset": "A", "sort": "up"}):
        with pytest.raises(errors.RequestError):
            files.BarsRequest(**bad)


def test_retries_wait(monkeypatch):
    waited, tries = [], []
    monkeypatch.setattr(files.time, "sleep", waited.append)

    def fetch():
        tries.append(1)
        if len(tries) < 3:
            raise errors.ResponseError("not yet")
        return "bars"

    assert files.fetch_with_retry(fetch) == "bars" and waited == [15.0, 15.0]
    with pytest.raises(errors.ResponseError):
        files.fetch_with_retry(lambda: (_ for _ in ()).throw(errors.ResponseError("no")), attempts=2)


def test_store_is_created_restored_and_refused(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    monkeypatch.setenv("BOURSE_CREATE", "no")
    assert store.open_store(spark, store.EngineConfig.from_env(folder)) == {}
    with pytest.raises(errors.UnknownTableError):
        store.open_store(spark, store.EngineConfig(folder, create=False, fail_fast=True))
    tables = store.open_store(spark, store.EngineConfig(folder))
    assert set(tables) == set(schemas.TABLES) and all(store.is_empty(t) for t in tables.values())
    for name, schema in schemas.TABLES.items():
        row = [{"long": 7, "double": 1.5, "string": "x"}.get(f.dataType.typeName()) for f in schema]
        files.write_csv(spark.createDataFrame([tuple(row)], schema), str(tmp_path / "csv" / name))
    tables = store.open_store(spark, store.EngineConfig(folder, restore_from=str(tmp_path / "csv")))
    assert all(t.count() == 1 for t in tables.values())


def test_tables_for_sql(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "id long")
    store.create_tables({"made_once": one})
    assert spark.table("made_once").count() == 1 and store.execute(spark, "SELECT * FROM made_once WHERE id = :id", id=1)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bourse_test LOCATION '{tmp_path}/db'")
    try:
        store.create_tables({"kept": one}, "bourse_test")
        store.create_tables({"kept": one.union(one)}, "bourse_test")
        assert spark.table("bourse_test.kept").count() == 1
    finally:
        spark.sql("DROP DATABASE bourse_test CASCADE")


def test_further_kinds(spark, monkeypatch):
    monkeypatch.setattr(store, "KINDS", dict(store.KINDS))
    store.register_kind("coupon", "Bond")
    rows = spark.createDataFrame([(1.0, None), (None, "S"), (None, None)], "coupon double, stock_name string")
    assert [r.asset_type for r in store.typed(rows).collect()] == ["Bond", "Stock", "Asset"]


def test_portfolio_errors(spark):
    held = spark.createDataFrame([("FX", "EURUSD"), ("Stock", "A")], "asset_type string, asset_name string")
    assert portfolio.add_asset(held, {"asset_type": "Forex", "asset_name": "EURUSD"}).filter("asset_type = 'FX'").count() == 2
    with pytest.raises(errors.DuplicateAssetError):
        portfolio.add_asset(held, {"asset_type": "Forex", "asset_name": "EURUSD"}, unique=True)
    with pytest.raises(errors.InvalidAssetTypeError):
        portfolio.add_asset(held, {"asset_type": "Bond", "asset_name": "B"})
    with pytest.raises(errors.EmptyPortfolioError):
        portfolio.remove_asset(held.limit(0), "Stock", "A")
    with pytest.raises(errors.AssetNotFoundError):
        portfolio.remove_asset(held, "Stock", "B")
    with pytest.raises(errors.EmptyPortfolioError):
        portfolio.moments(spark.createDataFrame([], "ticker string, date date, ret double"))


def test_holdings_net_of_sells(spark):
    rows = [(1, "A", "buy", 10, 5.0), (1, "A", "buy", 10, 7.0), (1, "A", "sell", 5, 9.0), (1, "B", "buy", 3, 1.0), (1, "B", "sell", 3, 1.0), (2, "C", "sell", 1, 1.0)]
    got = portfolio.holdings_of(spark.createDataFrame(rows, "portfolio_id long, ticker string, transaction_type string, quantity long, price double")).collect()
    assert [(r.portfolio_id, r.ticker, r.quantity, r.avg_cost) for r in got] == [(1, "A", 15, 6.0)]


def _moments(n=6, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n))
    return [f"T{i}" for i in range(n)], rng.normal(0.05, 0.1, n), a @ a.T / n + np.diag(rng.uniform(0.1, 1, n))


@pytest.mark.parametrize("kind, target", [("min_variance", None), ("mean_variance", None), ("max_sharpe", None), ("min_variance", 0.08)])
def test_bounded_optima(spark, kind, target):
    """Within bounds, no move of weight from one ticker to another helps: the conditions of Karush, Kuhn and Tucker."""
    known = names, mu, c = _moments()
    out = portfolio.optimise(spark.createDataFrame([], "ticker string, date date, ret double"), kind, least=0.02, most=0.35, target_return=target, known=known)
    w = np.array([r.weight for r in sorted(out.collect(), key=lambda r: r.ticker)])
    assert w.sum() == pytest.approx(1) and (w >= 0.02 - 1e-9).all() and (w <= 0.35 + 1e-9).all()
    gain = {"min_variance": -c @ w, "mean_variance": mu - 3 * c @ w, "max_sharpe": mu / (mu @ w) - c @ w / (w @ c @ w)}[kind]
    if target:
        assert w @ mu == pytest.approx(target, abs=1e-6)
        free = (w > 0.02 + 1e-6) & (w < 0.35 - 1e-6)
        if free.sum() > 2:  # then gain is a mix of the budget's and the target's multipliers
            basis = np.stack([np.ones(free.sum()), mu[free]], 1)
            assert np.abs(basis @ np.linalg.lstsq(basis, gain[free], rcond=None)[0] - gain[free]).max() < 1e-4
        return
    up, down = w < 0.35 - 1e-6, w > 0.02 + 1e-6  # who could take more, and who could give
    assert gain[up].max() <= gain[down].min() + 1e-4


def test_optimiser_refuses(spark):
    none = spark.createDataFrame([], "ticker string, date date, ret double")
    with pytest.raises(errors.RequestError):
        portfolio.optimise(none, least=0.0, most=0.1, known=_moments())
    with pytest.raises(errors.RequestError):
        portfolio.optimise(none, "min_variance", least=0.0, most=0.5, target_return=9.0, known=_moments())
    with pytest.raises(ValueError):
        portfolio.optimise(none, "best")


def test_ranks_of_skewed_values(spark):
    """Equal values, missing ones and an outlier: ranks as in one sorted list."""
    rows = [(i, 5.0 if i % 3 else 1e12 if i == 0 else None if i % 2 else float(i)) for i in range(400)]
    got = {r.id: r["rank"] for r in board.ranked(spark.createDataFrame(rows, "id long, v double"), "v", "id").collect()}
    expect = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(expect, 1)}


def test_ladders_in_blocks(spark):
    rows = [("S", i, 100.0 + i, 1 + i % 3, 50) for i in range(1, 60)] + [("T", 1, 9.0, 1, 5), ("U", 1, 9.0, 1, 0)]
    ladder = spark.createDataFrame(rows, "symbol string, level long, price double, size long, target long")
    whole, blocks = ({r.symbol: r.crossing_price for r in orderflow.crossing_level(ladder, block=b).collect()} for b in (1000, 7))
    assert whole == blocks and whole["T"] is None and whole["U"] == 9.0
    arrays = spark.createDataFrame([([10.0, 10.1, 10.2], [100, 200, 300])], "p array<double>, s array<long>")
    got = arrays.select(*[orderflow.crossing_in_arrays(F.col("p"), F.col("s"), F.lit(q)).alias(f"q{q}") for q in (0, 100, 101, 600, 601)]).first()
    assert list(got) == [10.0, 10.0, 10.1, 10.2, None]


def test_shared_folder(spark):
    assert shared.staged(spark.range(3), "three").count() == 3
    one, two = (shared.shared_path(spark, "x") for _ in range(2))
    assert one != two and f"/bourse-{spark.sparkContext.applicationId}/x-" in one and one.rpartition("/")[0] == two.rpartition("/")[0]

    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared.shared_path(Session, "x")

import json

import pytest
from pyspark.sql import functions as F

from bourse.errors import DelayedDataError, NoDataError, ResponseError
from bourse.sources import files, vendor
from bourse.streaming import ticks


def test_folder_of_answers(spark, tmp_path):
    vendor.register(spark)
    good = {"status": "OK", "resultsCount": 1, "results": [{"t": 1704153600000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10, "vw": 1.2}]}
    (tmp_path / "AAPL.json").write_text(json.dumps(good))
    rows = spark.read.format("vendor_bars").load(str(tmp_path)).collect()
    assert [(r.ticker, str(r.time), r.close_price, r.volume_weighted) for r in rows] == [("AAPL", "2024-01-02 00:00:00", 1.5, 1.2)]
    (tmp_path / "BAD.json").write_text('{"status": "ERROR"}')
    assert spark.read.format("vendor_bars").option("skip", "true").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="BAD.json"):
        spark.read.format("vendor_bars").load(str(tmp_path)).collect()


@pytest.mark.parametrize(("answer", "error"), [({"status": "ERROR"}, ResponseError), ({"status": "DELAYED", "resultsCount": 0}, DelayedDataError), ({"status": "OK", "resultsCount": 0}, NoDataError), ({"status": "OK", "resultsCount": 1}, ResponseError)])
def test_refused_answers(answer, error):
    with pytest.raises(error):
        vendor.check_answer(answer)


def test_retry():
    calls = []

    def fetch():
        calls.append(1)
        raise ResponseError("down")

    with pytest.raises(ResponseError):
        files.fetch_with_retry(fetch)
    assert len(calls) == 3
    assert files.fetch_with_retry(lambda: 7) == 7


def test_served_answers(spark):
    rows = spark.createDataFrame([(True, "x", None), (False, None, "gone")], "ok boolean, data string, error string")
    got = [json.loads(r.json) for r in files.answers(rows, "ok", "data").collect()]
    assert got == [{"status": "success", "data": "x"}, {"status": "error", "message": "gone"}]


def test_synthetic_ticks_are_a_stream(spark):
    rows = ticks.synthetic_ticks(spark)
    assert rows.isStreaming and {"price", "change"} <= set(rows.columns)


def test_synthetic_candles_join_up(spark):
    from bourse.operators import series

    rows = series.random_walk(spark, 20).orderBy("id").collect()
    assert all(abs(a.close - b.open) < 1e-9 for a, b in zip(rows, rows[1:]))
    assert all(r.low <= min(r.open, r.close) and max(r.open, r.close) <= r.high for r in rows)
    assert spark.range(1).select(F.lit(1)).count() == 1


def answer(*days):
    return json.dumps({"status": "OK", "resultsCount": len(days), "results": [{"t": 86_400_000 * d, "o": 1, "h": 2, "l": 0.5, "c": float(d), "v": 10} for d in days]})


def test_conditions_choose_the_files(spark, tmp_path):
    """Files that the conditions rule out would fail if they were opened."""
    vendor.register(spark)
    (tmp_path / "A_2024-01-01_2024-01-31.json").write_text(answer(19_724, 19_730))
    (tmp_path / "A_2023-01-01_2023-12-31.json").write_text("broken")
    (tmp_path / "B.json").write_text("broken")
    rows = spark.read.format("vendor_bars").load(f"file://{tmp_path}").filter("ticker = 'A' AND time >= TIMESTAMP'2024-01-05 00:00:00'")
    assert [(r.ticker, str(r.time), r.close_price, r.volume_weighted) for r in rows.collect()] == [("A", "2024-01-08 00:00:00", 19_730.0, None)]
    assert spark.read.format("vendor_bars").load(str(tmp_path)).filter("ticker IN ('C', 'D')").count() == 0
    assert spark.read.format("vendor_bars").load(str(tmp_path)).filter("ticker = 'A' AND time > TIMESTAMP'2025-01-01 00:00:00'").count() == 0
    with pytest.raises(Exception, match="B.json"):
        spark.read.format("vendor_bars").load(str(tmp_path)).filter("ticker = 'B'").count()


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    import os

    vendor.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("vendor_bars").load(str(folder))
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "log")).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.ticker, r.close_price) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for i, name in enumerate("CAB"):
        (folder / f"{name}.json").write_text(answer(i))
        os.utime(folder / f"{name}.json", (1000 + i, 1000 + i))
    assert run() == [("A", 1.0), ("B", 2.0), ("C", 0.0)]
    (folder / "A_2024-01-01_2024-01-31.json").write_text(answer(7, 8))
    assert run() == [("A", 1.0), ("A", 7.0), ("A", 8.0), ("B", 2.0), ("C", 0.0)]
    assert run() == [("A", 1.0), ("A", 7.0), ("A", 8.0), ("B", 2.0), ("C", 0.0)]

"""The durable table: what other readers see of writes that succeed, fail halfway or meet; exact quantiles."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from bourse.errors import ConflictError
from bourse.operators import quantiles
from bourse.sources.durable import DurableTable

DDL = "ticker string, date date, close double"


def rows(spark, *found):
    return spark.createDataFrame([(t, None if d is None else datetime.date.fromisoformat(d), c) for t, d, c in found], DDL)


def shown(df):
    return sorted(((r.ticker, str(r.date), r.close) for r in df.collect()), key=str)


def test_writes_are_read_by_another_session(spark, tmp_path):
    table = DurableTable(spark, str(tmp_path / "t"), DDL)
    assert table.read().count() == 0 and table.version() == 0
    table.insert(rows(spark, ("A", "2024-01-02", 1.0), ("A", "2024-02-02", 2.0), ("B", "2024-02-03", 3.0), ("C", None, 4.0)))
    table.insert(rows(spark, ("D", "2024-02-09", 5.0)))
    other = DurableTable(spark.newSession(), str(tmp_path / "t"), DDL)
    assert shown(other.read()) == [("A", "2024-01-02", 1.0), ("A", "2024-02-02", 2.0), ("B", "2024-02-03", 3.0), ("C", "None", 4.0), ("D", "2024-02-09", 5.0)]
    assert shown(other.read("2024-02-01", "2024-02-05")) == [("A", "2024-02-02", 2.0), ("B", "2024-02-03", 3.0)]
    before = table.months()
    table.delete("A", "2024-02-01", "2024-02-28")
    table.update("B", "2024-02-03", {"close": 9.0})
    assert shown(other.read()) == [("A", "2024-01-02", 1.0), ("B", "2024-02-03", 9.0), ("C", "None", 4.0), ("D", "2024-02-09", 5.0)]
    assert table.months()["2024-01"] == before["2024-01"] and table.months()["none"] == before["none"]  # other months stay as they lie
    assert len(shown(other.read(version=1))) == 4
    table.vacuum()
    assert len(shown(other.read())) == 4 and table.version() == 4
    table.delete("Z", "1999-01-01")
    assert table.version() == 4  # no such month


def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path):
    table = DurableTable(spark, str(tmp_path / "t"), DDL)
    table.insert(rows(spark, ("A", "2024-01-02", 1.0)))
    with pytest.raises(Exception, match="halfway"):
        table.replace(lambda old: old.withColumn("close", F.raise_error(F.lit("halfway")).cast("double")))
    assert shown(table.read()) == [("A", "2024-01-02", 1.0)] and table.version() == 1


def test_writers_that_meet(spark, tmp_path):
    table, other = (DurableTable(spark, str(tmp_path / "t"), DDL) for _ in range(2))
    table.insert(rows(spark, ("A", "2024-01-02", 1.0)))

    def meanwhile(old):
        other.insert(rows(spark, ("B", "2024-01-02", 2.0)))
        return old.filter("ticker <> 'A'")

    with pytest.raises(ConflictError):
        table.replace(meanwhile)
    assert shown(table.read()) == [("A", "2024-01-02", 1.0), ("B", "2024-01-02", 2.0)]


@pytest.mark.parametrize("small, bins", [(100_000, 32), (40, 32), (5, 3)])
def test_percentiles(spark, small, bins):
    """As Spark's own, with a third of the rows in one group, ties, and values far apart."""
    rng = random.Random(small)
    own = [("hot", rng.choice([rng.gauss(0, 1), 2.0**-rng.randrange(900), -1e300, 0.5, 0.5])) for _ in range(1500)]
    own += [(f"g{i % 20}", rng.random()) for i in range(1500)] + [("same", 7.0)] * 900 + [("one", 1.0), ("two", 1.0), ("two", 2.0), ("null", None), (None, 3.0)]
    df = spark.createDataFrame(own, "key string, x double")
    shares = [0.0, 0.05, 0.5, 0.999, 1.0]
    want = {r.key: (r.n, r.p) for r in df.filter("key IS NOT NULL AND x IS NOT NULL").groupBy("key").agg(F.count("x").alias("n"), F.percentile("x", shares).alias("p")).collect()}
    assert {r.key: (r.n, r.p) for r in quantiles.percentiles(df, "key", "x", shares, small, bins).collect()} == want
    assert quantiles.percentiles(df.limit(0), "key", "x", shares, small, bins).count() == 0


def test_percentiles_make_their_values_once(spark):
    """However many passes select the ranks, the rows' own plan runs once."""
    runs = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            runs.add(len(frame))
            yield frame

    df = spark.range(0, 3000, 1, 2).selectExpr("CAST(id % 2 AS STRING) AS key", "CAST(id * 7919 % 3001 AS DOUBLE) AS x").mapInPandas(seen, "key string, x double")
    got = quantiles.percentiles(df, "key", "x", [0.5], small=100)
    assert got.count() == 2 and runs.value == 3000

"""The served tables: scans, pages, writes."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..errors import UnknownTableError

log = logging.getLogger(__name__)

#: A page's rows by default, at least and at most.
PAGE, LEAST, MOST = 100, 1, 5000


@dataclass(frozen=True)
class Scan:
    """An optional ticker, optional inclusive dates, order and limit; an empty text is no condition, a negative limit none."""

    ticker: str = ""
    start: str = ""
    end: str = ""
    limit: int = 1000
    offset: int = 0
    ascending: bool = True

    def condition(self):
        parts = [F.col("ticker") == self.ticker] if self.ticker else []
        parts += [F.col("date") >= F.lit(self.start).cast("date")] if self.start else []
        parts += [F.col("date") <= F.lit(self.end).cast("date")] if self.end else []
        return reduce(and_, parts, F.lit(True))


def page_limit(text: str | None) -> int:
    """A page's rows as asked for: PAGE if that isn't a number, clamped."""
    try:
        n = int(text) if text not in (None, "") else PAGE
    except ValueError:
        n = PAGE
    return min(max(n, LEAST), MOST)


@dataclass(frozen=True)
class EngineConfig:
    """Where the served tables lie and how the store starts; ``from_env`` reads BOURSE_* variables."""

    folder: str
    create: bool = True
    fail_fast: bool = False
    restore_from: str = ""

    @classmethod
    def from_env(cls, folder: str) -> EngineConfig:
        return cls(os.environ.get("BOURSE_FOLDER", folder), env_flag("BOURSE_CREATE", True), env_flag("BOURSE_FAIL_FAST", False), os.environ.get("BOURSE_RESTORE_FROM", ""))


def open_store(spark, config: EngineConfig) -> dict[str, DataFrame]:
    """The served tables under the folder, Parquet each; a missing one is created empty or restored from CSV, if the configuration
    allows, and is an error or left out otherwise."""
    from . import files

    tables = {}
    for name, schema in schemas.TABLES.items():
        path = f"{config.folder.rstrip('/')}/{name}"
        try:
            rows = spark.read.schema(schema).parquet(path)
            rows.isEmpty()
        except AnalysisException as error:
            if not config.create:
                if config.fail_fast:
                    raise UnknownTableError(name) from error
                log.error("no table %s", name)
                continue
            spark.createDataFrame([], schema).write.parquet(path)
            rows = spark.read.schema(schema).parquet(path)
        if config.restore_from:
            rows = files.restore_if_empty(rows, lambda name=name: files.read_csv(spark, f"{config.restore_from.rstrip('/')}/{name}", name))
        tables[name] = rows
    return tables


#: Kinds of asset by the column that only their rows have; ``register_kind`` adds one.
KINDS = {"option_symbol": "Option", "forex_pair": "Forex", "crypto_symbol": "Crypto", "index_name": "Index", "stock_name": "Stock"}


def register_kind(column: str, kind: str) -> None:
    """A further kind of asset: rows that have ``column`` are of it."""
    KINDS[column] = kind


def typed(rows: DataFrame) -> DataFrame:
    """Rows with the ``asset_type`` that their columns tell: a column's kind where it has a value, Asset where none has."""
    kind = F.lit("Asset")
    for column, name in KINDS.items():
        if column in rows.columns:
            kind = F.when(F.col(column).isNotNull(), name).otherwise(kind)
    return rows.withColumn("asset_type", kind)


def option_defaults(rows: DataFrame) -> DataFrame:
    """Option records without gaps: no implied volatility and no strike are 0, and what isn't called a call is none."""
    return rows.withColumns({"implied_vol": F.coalesce("implied_vol", F.lit(0.0)), "strike": F.coalesce("strike", F.lit(0.0)), "is_call": F.coalesce("is_call", F.lit(False))})


def env_flag(name: str, default: bool) -> bool:
    value = os.environ.get(name, "")
    return value in ("1", "true", "TRUE", "yes", "YES") or (default and value not in ("0", "false", "FALSE", "no", "NO"))


def scan(tables: dict[str, DataFrame], name: str, ask: Scan, ties: tuple[str, ...] = ("ticker",)) -> DataFrame | None:
    """Rows of a table by date; None and a logged error for an unknown table. Conditions reach the scan; the order keeps ``limit`` rows in each task only."""
    if name not in tables:
        log.error("unknown table %s", name)
        return None
    date = F.col("date").asc_nulls_first() if ask.ascending else F.col("date").desc_nulls_last()
    rows = tables[name].filter(ask.condition()).orderBy(date, *ties)
    rows = rows.offset(ask.offset) if ask.offset else rows
    return rows.limit(ask.limit) if ask.limit >= 0 else rows


def is_empty(df: DataFrame | None) -> bool:
    """Errors count as empty."""
    try:
        return df is None or df.isEmpty()
    except Exception as error:  # noqa: BLE001
        log.error("emptiness probe failed: %s", error)
        return True


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def delete(df: DataFrame, ticker: str, date: str, until: str = "") -> DataFrame:
    """``df`` without a ticker's rows of a date, or of the dates up to ``until``."""
    hit = (F.col("ticker") == ticker) & F.col("date").between(F.lit(date).cast("date"), F.lit(until or date).cast("date"))
    return df.filter(~F.coalesce(hit, F.lit(False)))


def update(df: DataFrame, ticker: str, date: str, values: dict) -> DataFrame:
    hit = F.coalesce((F.col("ticker") == ticker) & (F.col("date") == F.lit(date).cast("date")), F.lit(False))
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def owned(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows whose id the parent table has."""
    return child.join(parent.select("id"), "id", "left_semi")


def orphans(child: DataFrame, parent: DataFrame) -> DataFrame:
    return child.join(parent.select("id"), "id", "left_anti")


def search(df: DataFrame, text: str, *cols: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(text.lower()) for c in cols]))


def execute(spark, sql: str, **args) -> bool:
    """Runs one statement with bound parameters; whether it succeeded."""
    try:
        spark.sql(sql, args=args)
        return True
    except Exception as error:  # noqa: BLE001
        log.error("statement failed: %s", error)
        return False


def create_tables(tables: dict[str, DataFrame], database: str = "") -> None:
    """Makes the tables known to SQL: as views of the session, or as tables of a database, where those that exist stay as they are."""
    for name, df in tables.items():
        if not database:
            df.createOrReplaceTempView(name)
        elif not df.sparkSession.catalog.tableExists(f"{database}.{name}"):
            df.write.saveAsTable(f"{database}.{name}")

"""CSV layouts, vendor envelopes, requests and addresses."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..errors import DelayedDataError, NoDataError, RequestError, ResponseError


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table in the layout that ``write_csv`` gives; bad fields become null."""
    return spark.read.schema(schemas.TABLES[table]).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def read_legacy_csv(spark: SparkSession, path: str, dedup: bool = True) -> DataFrame:
    """The older layout; volumes in scientific notation become whole numbers."""
    rows = spark.read.schema(schemas.LEGACY).option("header", True).csv(path).withColumn("volume", F.col("volume").cast("long"))
    return rows.dropDuplicates() if dedup else rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV as arrays of texts, header included, a trailing empty field dropped."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts).alias("fields"))


def restore_if_empty(stored: DataFrame, load) -> DataFrame:
    return load() if stored.isEmpty() else stored


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def to_envelope(df: DataFrame, key: str | None = None) -> DataFrame:
    """{results: [...], count} of a served page, or one for each value of ``key`` where a page isn't bounded."""
    rows = df.groupBy(*([key] if key else [])).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias("results"), F.count(F.lit(1)).alias("count"))
    return rows.select(*([key] if key else []), F.to_json(F.struct("results", "count")).alias("json"))


def answers(rows: DataFrame, ok: str, data: str, error: str = "error") -> DataFrame:
    """The served form of each row: {status: success, data} or {status: error, message}."""
    good = F.struct(F.lit("success").alias("status"), F.col(data).alias("data"))
    bad = F.struct(F.lit("error").alias("status"), F.col(error).alias("message"))
    return rows.withColumn("json", F.when(F.col(ok), F.to_json(good)).otherwise(F.to_json(bad)))


def parse_aggregates(texts: DataFrame, col: str = "value") -> DataFrame:
    """A vendor's answers, parsed, with ``error_class`` null where they can be used."""
    parsed = texts.withColumn("e", F.from_json(col, schemas.AGGREGATES))
    n = F.coalesce("e.resultsCount", F.lit(0))
    error = (
        F.when(F.col("e.status").isNull() | F.col("e").isNull(), "ResponseError").when(F.col("e.status") == "ERROR", "ResponseError")
        .when((F.col("e.status") == "DELAYED") & (n == 0), "DelayedDataError").when((F.col("e.status") == "OK") & (n == 0), "NoDataError")
    )
    return parsed.withColumn("error_class", error)


def bars_of(parsed: DataFrame) -> DataFrame:
    """The bars of usable answers; t is in milliseconds, in UTC."""
    rows = parsed.filter("error_class IS NULL").select(*[c for c in parsed.columns if c not in ("e", "error_class", "value")], F.explode("e.results").alias("r"))
    return rows.select(
        *[c for c in rows.columns if c != "r"], F.timestamp_millis("r.t").alias("time"), F.col("r.vw").alias("volume_weighted"), F.col("r.o").alias("open_price"), F.col("r.l").alias("lowest_price"),
        F.col("r.h").alias("highest_price"), F.col("r.c").alias("close_price"), F.col("r.v").alias("volume"), F.col("r.n").alias("n"),
    )


def check_answers(parsed: DataFrame) -> None:
    """Raises the first answer's error, if any has one."""
    bad = parsed.filter("error_class IS NOT NULL").select("error_class").first()
    if bad:
        raise {"ResponseError": ResponseError, "DelayedDataError": DelayedDataError, "NoDataError": NoDataError}[bad[0]](bad[0])


#: The days of a request without dates, and the seconds between two tries.
DEFAULT_DAYS, WAIT_SECONDS = 10, 15.0


@dataclass(frozen=True)
class BarsRequest:
    """Parameters of a request for range bars; without dates, those of the last DEFAULT_DAYS days to ``today``."""

    asset: str
    start: str = ""
    end: str = ""
    span: str = "day"
    multiplier: int = 1
    adjusted: bool = True
    sort: str = "asc"
    limit: int = 5000
    today: str = ""

    def __post_init__(self):
        last = date.fromisoformat(self.today) if self.today else date.today()
        object.__setattr__(self, "end", self.end or last.isoformat())
        object.__setattr__(self, "start", self.start or (last - timedelta(days=DEFAULT_DAYS)).isoformat())
        if not self.asset:
            raise RequestError("no asset")
        if self.span not in schemas.TIME_SPANS:
            raise RequestError(f"unknown span {self.span}")
        if self.start > self.end:
            raise RequestError("start is after end")
        if self.sort not in ("asc", "desc"):
            raise RequestError(f"unknown sort {self.sort}")

    def path(self) -> str:
        return f"/v2/aggs/ticker/{self.asset}/range/{self.multiplier}/{self.span}/{self.start}/{self.end}?adjusted={str(self.adjusted).lower()}&sort={self.sort}&limit={self.limit}"


def fetch_with_retry(fetch, attempts: int = 3, wait=lambda: time.sleep(WAIT_SECONDS)):
    """The result of ``fetch``, tried again after an error and a wait; the last error is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return fetch()
        except ResponseError:
            if not left:
                raise
            wait()


#: The vendor's data products and the first part of their addresses.
ENDPOINTS = {
    "AGGREGATES": "/v2/aggs/ticker/",
    "GROUPEDDAILY": "/v2/aggs/grouped/locale/",
    "DAILYOPENCLOSE": "/v1/open-close/",
    "PREVIOUSCLOSE": "/v2/aggs/ticker/",
    "TRADES": "/v3/trades/",
    "LASTTRADE": "/v2/last/trade/",
    "LASTTRADECRYPTOPAIR": "/v1/last/crypto/",
    "QUOTES": "/v3/quotes/",
    "LASTQUOTE": "/v2/last/nbbo/",
    "LASTQUOTECURRENCYPAIR": "/v1/last_quote/currencies/",
    "REALTIMECURRENCYCONVERSION": "/v1/conversion/",
    "SNAPSHOTSOPTIONCONTRACT": "/v3/snapshot/options/",
    "SNAPSHOTSOPTIONCHAIN": "/v3/snapshot/options/",
    "SNAPSHOTSUNIVERSALSNAPSHOT": "/v3/snapshot?ticker.any_of=",
    "SNAPSHOTSALLTICKERS": "/v2/snapshot/locale/",
    "SNAPSHOTSGAINERSLOSERS": "/v2/snapshot/locale/",
    "SNAPSHOTSTICKER": "/v2/snapshot/locale/",
    "TICKERS": "/v3/reference/tickers?active=true&",
    "TICKERDETAILSV3": "/v3/reference/tickers/",
    "TICKEREVENTS": "/vx/reference/tickers/",
    "TICKERNEWS": "/v2/reference/news?limit=",
    "TICKERTYPES": "/v3/reference/tickers/types?asset_class=",
    "MARKETHOLIDAYS": "/v1/marketstatus/upcoming?apikey=",
    "MARKETSTATUS": "/v1/marketstatus/now?apikey=",
    "STOCKSPLITSV3": "/v3/reference/splits?limit=",
    "DIVIDENDSV3": "/v3/reference/dividends?limit=",
    "STOCKFINANCIALSVX": "/vX/reference/financials?limit=",
    "CONDITIONS": "/v3/reference/conditions?asset_class=",
    "EXCHANGES": "/v3/reference/exchanges?asset_class=",
    "RELATEDCOMPANIES": "/v1/related-companies/",
    "IPOS": "/vX/reference/ipos?limit=",
    "OPTIONCONTRACT": "/v3/reference/options/contracts/",
    "OPTIONSCONTRACTS": "/v3/reference/options/contracts?limit=",
}


def endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ENDPOINTS.items()), "kind string, path string")


def with_endpoint(requests: DataFrame) -> DataFrame:
    """Each request's address by its kind; an unknown kind has UNKNOWN."""
    return requests.join(F.broadcast(endpoints(requests.sparkSession)), "kind", "left").withColumn("path", F.coalesce("path", F.lit("UNKNOWN")))


#: A request's parameters where it names none.
REQUEST = {"start": "2024-01-09", "end": "2025-01-09", "day": "2024-01-09", "span": "day", "multiplier": "1", "sort": "asc", "limit": "5000", "adjusted": "true", "amount": "100.0", "contract": "", "movers": "gainers"}


def request_paths(requests: DataFrame) -> DataFrame:
    """``address`` of each request (kind, symbol, and those of REQUEST's columns that differ from its values), as the vendor documents it.

    A symbol bears its class's prefix. The key isn't part of an address: it belongs into a request's header.
    """
    from ..functions import symbols as S

    rows = with_endpoint(requests)
    of = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in REQUEST.items()}
    symbol, kind, path = F.col("symbol"), F.col("kind"), F.col("path")
    bare, asset = S.bare_symbol(symbol), S.asset_class(symbol)
    base, quote = S.pair_parts(bare)
    locale = F.concat(path, S.locale(asset), F.lit("/"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    limited = text("limit=", of["limit"])
    by_kind = {
        "AGGREGATES": text(path, symbol, "/range/", of["multiplier"], "/", of["span"], "/", of["start"], "/", of["end"], "?adjusted=", of["adjusted"], "&sort=", of["sort"], "&", limited),
        "GROUPEDDAILY": text(locale, of["day"], "?adjusted=", of["adjusted"]),
        "DAILYOPENCLOSE": text(path, symbol, "/", of["day"], "?adjusted=", of["adjusted"]),
        "PREVIOUSCLOSE": text(path, symbol, "/prev?adjusted=", of["adjusted"]),
        **dict.fromkeys(("TRADES", "QUOTES"), text(path, symbol, "?", limited)),
        **dict.fromkeys(("LASTTRADE", "LASTQUOTE", "TICKERDETAILSV3", "RELATEDCOMPANIES", "OPTIONCONTRACT"), text(path, symbol)),
        **dict.fromkeys(("LASTTRADECRYPTOPAIR", "LASTQUOTECURRENCYPAIR"), text(path, base, "/", quote)),
        "REALTIMECURRENCYCONVERSION": text(path, base, "/", quote, "?amount=", of["amount"]),
        "SNAPSHOTSOPTIONCONTRACT": text(path, symbol, "/", of["contract"]),
        "SNAPSHOTSOPTIONCHAIN": text(path, symbol, "?", limited),
        "SNAPSHOTSUNIVERSALSNAPSHOT": text(path, symbol),
        "SNAPSHOTSALLTICKERS": text(locale, "tickers?tickers=", symbol),
        "SNAPSHOTSGAINERSLOSERS": text(locale, of["movers"]),
        "SNAPSHOTSTICKER": text(locale, "tickers/", symbol),
        "TICKERS": text(path, "ticker=", symbol, "&", limited),
        "TICKEREVENTS": text(path, symbol, "/events"),
        **dict.fromkeys(("TICKERNEWS", "STOCKSPLITSV3", "DIVIDENDSV3", "STOCKFINANCIALSVX", "IPOS"), text(path, of["limit"], "&ticker=", symbol)),
        "OPTIONSCONTRACTS": text(path, of["limit"], "&underlying_ticker=", symbol),
        **dict.fromkeys(("TICKERTYPES", "CONDITIONS", "EXCHANGES"), text(path, S.asset_parameter(asset))),
        **dict.fromkeys(("MARKETHOLIDAYS", "MARKETSTATUS"), F.regexp_replace(path, r"\?.*", "")),
    }
    address = path
    for name, form in by_kind.items():
        address = F.when(kind == name, form).otherwise(address)
    return rows.withColumn("address", address)


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """Board items (name, price, change) from JSON files: one item a line, or an array of them; null where a field can't be read."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split(F.trim("value"), r"\n"), lambda x: F.length(F.trim(x)) > 0)).alias("value"))
    items = F.coalesce(F.from_json("value", T.ArrayType(schemas.BOARD)), F.array(F.from_json("value", schemas.BOARD)))
    return lines.select(F.explode(items).alias("x")).select("x.*")


def quarantine(rows: DataFrame, text_date: str = "date_text") -> tuple[DataFrame, DataFrame]:
    """Rows whose ticker and ISO date are sound, and the others."""
    day = F.try_to_date(text_date, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.col(text_date).try_cast("date")
    rows = rows.withColumn("date", day)
    good = F.col("ticker").isNotNull() & F.col("date").isNotNull()
    return rows.filter(good), rows.filter(~good)

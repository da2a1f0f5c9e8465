"""A data source over vendor answers kept as JSON files: ``spark.read.format("vendor_bars").load(folder)``."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import DelayedDataError, NoDataError, ResponseError

#: Rows of an Arrow batch.
BATCH = 10_000
COLUMNS = ["ticker", "time", "open_price", "highest_price", "lowest_price", "close_price", "volume", "volume_weighted"]
_DAYS = re.compile(r"(.+)_(\d{4}-\d\d-\d\d)_(\d{4}-\d\d-\d\d)")


def check_answer(answer: dict) -> dict:
    """The answer, if it can be used."""
    status, count = answer.get("status"), answer.get("resultsCount", 0)
    if status == "DELAYED" and not count:
        raise DelayedDataError(status)
    if status == "OK" and not count:
        raise NoDataError(status)
    if status not in ("OK", "DELAYED") or not isinstance(answer.get("results"), list):
        raise ResponseError(str(status))
    return answer


class VendorBars(DataSource):
    """One partition per file of a folder in any store that the executors reach (a local path, hdfs://, s3://, gs://).

    A file is named ``TICKER.json``, or ``TICKER_2024-01-01_2024-01-31.json`` if it answers for those days. Conditions on ticker
    and time choose the files before any is opened (spark.sql.python.filterPushdown.enabled, which ``register`` sets), and rows
    come in Arrow batches. As a stream, a batch takes the files that have changed since the one before.

    Options: ``attempts`` (3), how often a file that can't be used is read before its error is raised; ``skip``
    (false), to leave out such files instead.
    """

    @classmethod
    def name(cls):
        return "vendor_bars"

    def schema(self):
        return "ticker string, time timestamp, open_price double, highest_price double, lowest_price double, close_price double, volume double, volume_weighted double"

    def reader(self, schema):
        return VendorReader(self.options)

    def streamReader(self, schema):
        return VendorStream(self.options)


class Answers:
    """The files of a folder, and the bars of one."""

    def __init__(self, options):
        self.path, self.attempts, self.skip = options["path"], int(options.get("attempts", 3)), options.get("skip", "false").lower() == "true"

    def listed(self) -> list[tuple[int, str]]:
        """The time of change and the path of each file, in order."""
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path.removeprefix("file:")))
        found = store.get_file_info(fs.FileSelector(folder))
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.path.endswith(".json"))

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import fs

        if partition is None:  # no file has what is asked for
            return
        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path.removeprefix("file:")))
        answer = None
        for left in range(self.attempts - 1, -1, -1):
            try:
                with store.open_input_stream(partition.value) as f:
                    answer = check_answer(json.loads(f.read()))
                break
            except (ResponseError, json.JSONDecodeError) as error:
                if not left and not self.skip:
                    raise ResponseError(f"{partition.value}: {error}") from error
        rows = answer["results"] if answer else []
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            times = pa.array([r["t"] * 1000 for r in part], pa.int64()).cast(pa.timestamp("us", "UTC"))
            numbers = [pa.array([None if r.get(k) is None else float(r[k]) for r in part], pa.float64()) for k in ("o", "h", "l", "c", "v", "vw")]
            yield pa.RecordBatch.from_arrays([pa.array([named(partition.value)[0]] * len(part)), times, *numbers], names=COLUMNS)


def named(path: str) -> tuple[str, str, str]:
    """The ticker of a file's name, and the first and last day that it answers for ("" without)."""
    name = path.rsplit("/", 1)[-1].removesuffix(".json")
    m = _DAYS.fullmatch(name)
    return (m[1], m[2], m[3]) if m else (name, "", "")


class VendorReader(Answers, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.tickers, self.first, self.last = None, "", ""

    def pushFilters(self, filters):
        """Takes note of what tickers and days are asked for; Spark still checks every row, as a file may have more."""
        for f in filters:
            if f.attribute == ("ticker",) and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = asked if self.tickers is None else self.tickers & asked
            elif f.attribute == ("time",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.first = max(self.first, str(f.value)[:10])
            if f.attribute == ("time",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.last = min(self.last or "9999", str(f.value)[:10])
            yield f

    def partitions(self):
        """The files that may have rows; days are compared with one day to spare, for time zones."""
        out = []
        for _, path in self.listed():
            ticker, start, end = named(path)
            if (self.tickers is None or ticker in self.tickers) and not (end and self.first and _moved(end, 1) < self.first) and not (start and self.last and _moved(start, -1) > self.last):
                out.append(InputPartition(path))
        return out


def _moved(day: str, days: int) -> str:
    from datetime import date, timedelta

    return str(date.fromisoformat(day) + timedelta(days))


class VendorStream(Answers, DataSourceStreamReader):
    """Offsets are the time of change and path of the last file that was taken, so a stream goes on where its checkpoint ends."""

    def __init__(self, options):
        super().__init__(options)
        self.at = None

    def initialOffset(self):
        return {"changed": -1, "path": ""}

    def _after(self, offset):
        return [f for f in self.listed() if f > (offset["changed"], offset["path"])]

    def latestOffset(self):
        ahead = self._after(self.at or self.initialOffset())
        if ahead:
            self.at = {"changed": ahead[-1][0], "path": ahead[-1][1]}
        return self.at or self.initialOffset()

    def partitions(self, start, end):
        self.at = end
        return [InputPartition(path) for changed, path in self._after(start) if (changed, path) <= (end["changed"], end["path"])]


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorBars)

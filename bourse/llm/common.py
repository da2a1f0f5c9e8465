"""What the operators of this subpackage share: tables, shared storage and Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names. Where none is named, a
    temporary one if the executors are threads of the driver (tests); on a cluster, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(shared_dir, "fallback"):
        shared_dir.fallback = tempfile.mkdtemp(prefix="bourse-")
    return shared_dir.fallback


_made = threading.local()


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: a cut of the lineage that outlives an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if not hasattr(_made, "paths"):
        _made.paths = []
    _made.paths.append(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in getattr(_made, "paths", ()):
        _made.paths.remove(path)


def discard(df: DataFrame) -> None:
    """Removes a table made by ``materialise`` which nothing reads any more."""
    if getattr(df, "_shared_path", None):
        _remove(df.sparkSession, df._shared_path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def mark() -> int:
    """The place in this thread's list of tables, for ``sweep``."""
    return len(getattr(_made, "paths", ()))


def sweep(since: int, out: DataFrame) -> DataFrame:
    """Removes the tables made since ``mark`` that ``out`` doesn't read, and returns it."""
    used = out.inputFiles()
    for path in list(getattr(_made, "paths", ())[since:]):
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in used):
            _remove(out.sparkSession, path)
    return out


def text_binary(col: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


def batches(rows_of, schema: pa.Schema):
    """A ``mapInArrow`` function from one that turns a record batch into a dict of columns, or None."""

    def run(stream):
        for batch in stream:
            for part in slices(batch):
                out = rows_of(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, t) for a, t in zip(out, schema.types)], schema=schema)

    return run


def slices(batch: pa.RecordBatch, most: int = 16 << 20):
    """The batch in runs of rows of about ``most`` bytes, so that long texts don't pile up in a worker."""
    n = batch.num_rows
    if n < 2 or batch.nbytes <= most:
        if n:
            yield batch
        return
    half = n // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def one_of_each(docs: DataFrame, groups_of, group: str, rank, best) -> DataFrame:
    """One row of each group of ``docs``: the one whose ``rank`` is ``best`` (F.min or F.max), with the columns of ``docs``.

    Rows are told apart by a key of their own, written with them, so those that repeat a doc_id or have none
    are decided like any other. ``groups_of`` is given the texts with that key as doc_id, and tells the group of
    each in the column ``group``. The keys grow with the input, so the joins are merge joins at every size.
    """
    row = fresh(docs, "row")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    groups = groups_of(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col(group).alias("group"))
    ranked = keyed.select(row, F.struct(*rank, F.col(row).alias("row")).alias("rank")).join(groups.hint("merge"), row)
    kept = ranked.groupBy("group").agg(best("rank").alias("rank")).select(F.col("rank.row").alias(row))
    return keyed.join(kept.hint("merge"), row, "left_semi").drop(row)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with more than this part of the rows are joined by broadcast: there are fewer than SPLIT of them.
SPLIT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Each row with its key's one row of ``groups``, where ``weight`` tells how many rows the key has.

    Keys that hold over a SPLIT-th of all of them, fewer than SPLIT, are broadcast, so their rows stay where they are; the
    others' are joined by a merge join, where no task can be given a hot key. ``groups`` should be a written table.
    """
    total = groups.agg(F.sum(F.col(weight).cast("decimal(38,0)"))).first()[0] or 0
    hot = groups.filter(F.col(weight).cast("decimal(38,0)") * SPLIT > F.lit(total))
    cold = groups.filter(F.col(weight).cast("decimal(38,0)") * SPLIT <= F.lit(total))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)

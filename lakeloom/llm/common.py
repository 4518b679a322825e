"""What the operators share: the folder that all executors see, written tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: the space and the controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"

#: A table is broadcast up to this many rows; beyond, the caller joins by shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests), one of our own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="lakeloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


_SHIPPED: set[str] = set()


#: Rows and bytes of a batch that goes to a Python worker: whole texts are long, so the defaults would hold too many.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, which may not have it, once for each application; and bounds their batches."""
    import shutil
    from pathlib import Path

    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    package = Path(__file__).resolve().parents[1]
    if spark.sparkContext.applicationId not in _SHIPPED and package.is_dir():
        name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lakeloom-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(spark.sparkContext.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lakeloom/{label}-{uuid.uuid4().hex}"


#: Once what it made is written, a query's shuffle files have done their work.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written within goes at its end, but for what is to be kept, which goes with the scope around, if any."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def _there(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def delete(spark: SparkSession, path: str) -> None:
    fs, there = _there(spark, path)
    fs.delete(there, True)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, there = _there(spark, path)
    fs.mkdirs(there)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts its lineage. `keep`: see `scratch`."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """Those that the session shuffles to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As `written`, dealt out by `key`: joins and groups by it move only the other side."""
    spark, path, name, n = df.sparkSession, new_path(df.sparkSession, label), f"lakeloom_{uuid.uuid4().hex}", partitions(df)
    with writing(spark):
        df.repartition(n, key).write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now, as the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that repartition() by it deals there."""
    found: dict[int, int] = {}
    low = 0
    while len(found) < n:
        ids = spark.range(low, low + 8 * n + 64)
        found = {r[0]: r[1] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect()} | found
        low += 8 * n + 64
    return [found[k] for k in range(n)]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The written table with a broadcast hint if it has no more than `rows` rows, else without."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _there(spark, path)
    return fs.exists(there)


def unused(df: DataFrame, name: str) -> str:
    """A name like it that no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, name
    while out.lower() in taken:
        out += "_"
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def located(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows with a locator each (a struct of file, by a hash of its path, and row), and the name of its column.

    Rows that don't come straight from files are written first.
    """
    name = unused(docs, "at")
    try:
        out = docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
        out.schema  # analysed here
        return out, name
    except AnalysisException:
        return written(docs.select("*", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")).alias(name)), label, keep=True), name


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; executors call it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Parquet files of a lake: writing with statistics from footers, paths, and removal."""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Footers that the driver reads itself; more are read by a job.
DRIVER_FOOTERS = 256
BROADCAST_ROWS = 200_000  # some 40 MB of paths


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in milliseconds) of all Parquet files below."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        if name.endswith(".parquet") and not f.getPath().getName().startswith(("_", ".")):
            out.append((name, f.getLen(), f.getModificationTime()))
    return sorted(out)


def raw_path(spark: SparkSession, path: str) -> str:
    """The path as _metadata.file_path spells it, without scheme and host."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getRawPath()


def own_path() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")


def local(path: str) -> str | None:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _text(v: Any) -> str | None:
    if isinstance(v, bytes):
        try:
            return v.decode()
        except UnicodeDecodeError:
            return None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None or v != v else str(v)


def footer(path: str) -> tuple[int, dict[str, tuple[int, int | None, str | None, str | None]]]:
    """Rows, and (values, nulls, low, high) of each top column of one value."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(path)
    stats: dict[str, list] = {}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            if "." in col.path_in_schema:
                continue
            s = col.statistics
            x = stats.setdefault(col.path_in_schema, [0, 0, [], []])
            x[0] += col.num_values
            x[1] = None if s is None or not s.has_null_count or x[1] is None else x[1] + s.null_count
            if col.physical_type == "INT96":  # has no order of its own
                x[2].append(None)
            elif s is not None and s.has_min_max:
                x[2].append(s.min), x[3].append(s.max)
            elif not (s is not None and s.has_null_count and s.null_count == col.num_values):
                x[2].append(None)
    out = {}
    for name, (n, nulls, low, high) in stats.items():
        ok = bool(low) and None not in low
        out[name] = (n, nulls, _text(min(low)) if ok else None, _text(max(high)) if ok else None)
    return meta.num_rows, out


def footers(spark: SparkSession, paths: list[str], schema: T.StructType) -> dict[str, tuple[int, dict]]:
    here = {p: local(p) for p in paths}
    if None not in here.values() and len(paths) <= DRIVER_FOOTERS:
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(paths, pool.map(footer, here.values()), strict=True))
    # Where only Spark reads: one aggregate for each file.
    cols = [f for f in schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType | T.VariantType)]
    aggs = [F.count("*").alias("n")]
    for k, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        sound = F.when(~F.isnan(c), c) if isinstance(f.dataType, T.FloatType | T.DoubleType) else c
        nan = F.count_if(F.isnan(c)) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.lit(0)
        aggs += [F.count_if(c.isNull()).alias(f"u{k}"), F.min(sound).alias(f"l{k}"), F.max(sound).alias(f"h{k}"), nan.alias(f"x{k}")]
    keys = {raw_path(spark, p): p for p in paths}
    out = {}
    for r in spark.read.schema(schema).parquet(*paths).groupBy(own_path().alias("_path")).agg(*aggs).collect():  # a row for each file
        clean = {f.name: (r["n"], r[f"u{k}"], _text(r[f"l{k}"]) if not r[f"x{k}"] else None, _text(r[f"h{k}"]) if not r[f"x{k}"] else None) for k, f in enumerate(cols)}
        out[keys[r["_path"]]] = (r["n"], clean)
    return {p: out.get(p, (0, {})) for p in paths}


def listed(df: DataFrame, n: int) -> DataFrame:
    """A list of n short rows, sent to all executors while it is small."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def write(df: DataFrame, folder: str, keys: list[tuple[str, Column]], options: dict[str, str], target_bytes: int, width: int = 0, spread: bool = True) -> list[dict]:
    """Writes Parquet files under a new folder, hive-style by `keys`; their paths, sizes, rows, statistics and key values.

    `width`: bytes of a row in files that are there; without any, a guess by the types. `spread`: rebalance by the keys.
    """
    spark = df.sparkSession
    place = f"{folder}/{uuid.uuid4().hex}"
    row = width or max(1, df._jdf.schema().defaultSize() // 2)
    out = df
    if keys:
        out = out.withColumns(dict(keys))
        out = out.hint("rebalance", *[k for k, _ in keys]) if spread else out
    w = out.write.options(**options).option("maxRecordsPerFile", max(1, target_bytes // row))
    (w.partitionBy(*[k for k, _ in keys]) if keys else w).parquet(place)
    found = listing(spark, place)
    stats = footers(spark, [p for p, _, _ in found], df.schema)
    files = []
    for path, size, _ in found:
        n, cols = stats[path]
        if n:
            values = [part.split("=", 1)[1] for part in path.split("/")[:-1] if "=" in part and part.split("=", 1)[0] in {k for k, _ in keys}]
            files.append({"path": path, "bytes": size, "rows": n, "stats": cols, "partition": [unescape(v) for v in values]})
        else:
            remove(spark, path)
    return files


def unescape(v: str) -> str | None:
    """A value in a hive-style path."""
    from urllib.parse import unquote

    return None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)

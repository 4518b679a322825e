"""What changed between two snapshots, both included: rows inserted, rows deleted, and the two paired by row id."""

from __future__ import annotations

import datetime as dt
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..sources import scan
from ..sources.scan import META

if TYPE_CHECKING:
    from ..sources.lake import Lake, Table


def bounds(lake: Lake, start: Any, end: Any) -> tuple[int, int]:
    """Snapshot ids, or points in time: the first snapshot not before `start`, the last not after `end`."""
    if start is None or end is None:
        raise InvalidInput("a change feed needs a first and a last snapshot")
    timed = lambda x: isinstance(x, str | dt.datetime)
    a = lake._cat.at(timestamp=start, lower=True) if timed(start) else int(start)
    return a, lake._cat.at(timestamp=end) if timed(end) else lake._cat.at(int(end))


def _of(lake: Lake, name: str, end: int) -> Table:
    if lake._find("tbl", name, end) is None and lake._find("view", name, end) is not None:
        raise InvalidInput(f"{name} is a view; only tables have a change feed")
    return lake._table(name, end)


def _columns(t: Table) -> list[str]:
    return [f"`{f['name']}`" for f in t.fields]


def _named(df: DataFrame, t: Table) -> DataFrame:
    return df.select(F.col("_snapshot_id").alias("snapshot_id"), F.col("_row_id").alias("rowid"), *_columns(t))


def insertions(lake: Lake, name: str, start: Any, end: Any) -> DataFrame:
    """snapshot_id, rowid and the columns, under the schema of `end`; rows deleted later are there too."""
    a, b = bounds(lake, start, end)
    t, cat = _of(lake, name, b), lake._c
    rows = cat.rows("SELECT * FROM data_file WHERE table_id = :t AND origin NOT LIKE 'rewrite%' AND begin <= :b AND (begin >= :a OR partial_max >= :a)", t=t.id, a=a, b=b)
    out = scan.read_files(lake, cat, t, rows, True).filter(F.col("_snapshot_id").between(a, b))
    own = scan.inlined(lake, cat, t, "begin BETWEEN :a AND :b", {"a": a, "b": b}, meta=True)
    return _named(out.unionByName(own) if own is not None else out, t)


def deletions(lake: Lake, name: str, start: Any, end: Any) -> DataFrame:
    """snapshot_id (of the delete), rowid and the columns of rows that went."""
    a, b = bounds(lake, start, end)
    t, cat = _of(lake, name, b), lake._c
    cols = _columns(t)
    gone, touched = scan.deleted(lake, cat, t, b, since=a)
    rows = [r for r in cat.rows("SELECT * FROM data_file WHERE table_id = :t AND origin NOT LIKE 'rewrite%'", t=t.id) if r["id"] in touched]
    out = None
    if rows:
        out = scan.read_files(lake, cat, t, rows, True).join(gone, ["_file_id", "_pos"]).select(*cols, "_file_id", "_pos", "_row_id", F.col("_deleted_at").alias("_snapshot_id"))
    # Files that ended as a whole: what was still alive in them.
    ended = cat.rows("SELECT * FROM data_file WHERE table_id = :t AND stop BETWEEN :a AND :b AND (origin LIKE '%/deleted' OR NOT EXISTS (SELECT 1 FROM tbl WHERE id = :t AND (stop IS NULL OR stop > :b)))", t=t.id, a=a, b=b)
    for stop in sorted({r["stop"] for r in ended}):
        own = [r for r in ended if r["stop"] == stop]
        df = scan.alive(lake, cat, t, own, stop - 1, True).select(*cols, *META).withColumn("_snapshot_id", F.lit(stop).cast("long"))
        out = df if out is None else out.unionByName(df)
    own = scan.inlined(lake, cat, t, "stop BETWEEN :a AND :b", {"a": a, "b": b}, meta=True, stop=True)
    if own is not None:
        own = own.withColumn("_snapshot_id", F.col("_stop")).drop("_stop")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = scan.read_files(lake, cat, t, [], True)
    return _named(out, t)


def changes(lake: Lake, name: str, start: Any, end: Any) -> DataFrame:
    """snapshot_id, rowid, change_type and the columns. A row deleted and inserted under its id in one snapshot was updated."""
    new, old = insertions(lake, name, start, end), deletions(lake, name, start, end)
    keys = ["snapshot_id", "rowid"]
    cols = [c for c in new.columns if c not in keys]
    sides = [
        (new, old, "update_postimage", "insert"),
        (old, new, "update_preimage", "delete"),
    ]
    out = []
    for one, other, both, alone in sides:
        marked = one.join(other.select(*keys).distinct().withColumn("_both", F.lit(True)), keys, "left")
        out.append(marked.select(*keys, F.when(F.col("_both"), both).otherwise(alone).alias("change_type"), *[f"`{c}`" for c in cols]))
    return out[0].unionByName(out[1])

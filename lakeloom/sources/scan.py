"""From the catalog's file lists to DataFrames.

Files are read in groups of one schema version and brought to the schema asked for by field ids. Only where a row's
identity matters (deletes, row ids, embedded snapshots) are the file's place and the row's number in it joined to the
catalog's list of files, which is small; plain scans stay plain Parquet scans.
"""

from __future__ import annotations

import json
import sqlite3
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import prune
from ..plans.parsed import Expression, column
from . import files, schema
from .catalog import VISIBLE, Catalog

if TYPE_CHECKING:
    from .lake import Lake, Table

META = ["_file_id", "_pos", "_row_id", "_snapshot_id"]
_META_SCHEMA = "_file_id long, _pos long, _row_id long, _snapshot_id long"


def live_files(lake: Lake, cat: Catalog, t: Table, at: int, where: str | None = None) -> list[sqlite3.Row]:
    rows = cat.rows(f"SELECT * FROM data_file WHERE table_id = :t AND {VISIBLE} ORDER BY id", t=t.id, s=at)
    return pruned(lake, cat, t, rows, where) if where else rows


def pruned(lake: Lake, cat: Catalog, t: Table, rows: list[sqlite3.Row], where: str) -> list[sqlite3.Row]:
    p = prune.parse(lake.spark, where)
    if p is None or not rows:
        return rows
    names: set[str] = set()

    def names_of(p) -> None:
        if p[0] in ("and", "or"):
            names_of(p[1]), names_of(p[2])
        else:
            names.add(p[0].lower())

    names_of(p)
    own = {f["name"].lower(): f for f in t.fields}
    stats: dict[int, dict[str, tuple]] = {}
    for n in names & set(own):
        f = own[n]
        for r in cat.rows("SELECT * FROM file_stats WHERE table_id = :t AND column_id = :c", t=t.id, c=f["id"]):
            stats.setdefault(r["file_id"], {})[n] = (r["nulls"], r["low"], r["high"], r["nan"])
    specs = {r["id"]: json.loads(r["keys"]) for r in cat.rows("SELECT * FROM partition_spec WHERE table_id = :t", t=t.id)}
    values: dict[int, dict[int, str | None]] = {}
    if any(k["transform"] == "bucket" for keys in specs.values() for k in keys):
        for r in cat.rows("SELECT * FROM file_partition WHERE table_id = :t", t=t.id):
            values.setdefault(r["file_id"], {})[r["k"]] = r["value"]
    by_id = {f["id"]: f["name"].lower() for f in t.fields}

    def buckets(r: sqlite3.Row) -> dict[str, tuple[int, int | None]]:
        keys = specs.get(r["partition_id"], [])
        return {by_id[k["field"]]: (k["arg"], int(v) if (v := values.get(r["id"], {}).get(i)) is not None else -1) for i, k in enumerate(keys) if k["transform"] == "bucket" and k["field"] in by_id and r["id"] in values}

    return [r for r in rows if prune.keeps(p, prune.File(r["rows"], stats.get(r["id"], {}), buckets(r), {}), t.type)]


def fields_at(cat: Catalog, table_id: int, version: int) -> list[dict]:
    return json.loads(cat.one("SELECT fields FROM tbl_schema WHERE table_id = :t AND version = :v", t=table_id, v=version)["fields"])


def read_files(lake: Lake, cat: Catalog, t: Table, rows: list[sqlite3.Row], meta: bool, fields: list[dict] | None = None) -> DataFrame:
    """The files' rows, deleted ones too, as columns of `fields` and, with `meta`, META."""
    spark, fields = lake.spark, fields or t.fields
    out: DataFrame | None = None
    groups: dict[tuple, list[sqlite3.Row]] = {}
    for r in rows:
        groups.setdefault((r["schema_version"], r["mapping_id"], r["embeds"]), []).append(r)
    for (version, mapping, embeds), own in groups.items():
        old = fields_at(cat, t.id, version)
        extra: list[Column] = []
        reader = schema.plain_schema(old)
        names = None
        if mapping is not None:
            names = json.loads(cat.one("SELECT columns FROM mapping WHERE id = :i", i=mapping)["columns"])
            reader = T.StructType([T.StructField(names[str(f["id"])]["column"], schema.field_type(f)) for f in old if "column" in names.get(str(f["id"]), {})])
        if embeds:
            reader = T.StructType([*reader.fields, T.StructField("_row_id", T.LongType()), T.StructField("_snapshot_id", T.LongType())])
        df = spark.read.schema(reader).parquet(*[r["path"] for r in own])
        if meta:
            extra = [files.own_path().alias("_path"), F.col("_metadata.row_index").alias("_pos")]
        cols = [F.col(f"`{f.name}`") for f in reader.fields]
        if names is not None:
            cols = []
            for f in old:
                n = names.get(str(f["id"]), {})
                c = F.col(f"`{n['column']}`") if "column" in n else F.lit(n["value"]).cast(schema.field_type(f)) if "value" in n else schema.literal(f["initial"], schema.field_type(f))
                cols.append(c.alias(f["name"]))
            if embeds:
                cols += [F.col("_row_id"), F.col("_snapshot_id")]
        df = df.select(*cols, *extra)
        if meta:
            known = [(files.raw_path(spark, r["path"]), r["id"], r["row_id_start"], r["begin"]) for r in own]
            table = spark.createDataFrame(known, "_p string, _file_id long, _start long, _begin long")
            df = df.join(files.listed(table, len(known)), F.col("_path") == F.col("_p"))  # a row for each file in the catalog's list
            row_id, snap = F.col("_start") + F.col("_pos"), F.col("_begin")
            if embeds:
                row_id, snap = F.coalesce("_row_id", row_id), F.coalesce("_snapshot_id", snap)
            df = df.select(*[F.col(f"`{f['name']}`") for f in old], "_file_id", "_pos", row_id.alias("_row_id"), snap.alias("_snapshot_id"))
        elif embeds:
            df = df.drop("_row_id", "_snapshot_id")
        df = schema.project(df, old, fields, META if meta else [])
        out = df if out is None else out.unionByName(df)
    if out is None:
        empty = schema.plain_schema(fields)
        out = spark.createDataFrame([], T.StructType([*empty.fields, *(T._parse_datatype_string(_META_SCHEMA).fields if meta else [])]))
    return out


def deleted(lake: Lake, cat: Catalog, t: Table, at: int, file_ids: set[int] | None = None, since: int | None = None) -> tuple[DataFrame | None, set[int]]:
    """(_file_id, _pos, _deleted_at) of positions deleted by snapshot `at` (from `since` on), and the files that have any."""
    spark = lake.spark
    low = -1 if since is None else since - 1
    rows = cat.rows("SELECT * FROM delete_of WHERE table_id = :t AND begin <= :s AND begin > :l", t=t.id, s=at, l=low)
    small = cat.rows("SELECT * FROM inlined_delete WHERE table_id = :t AND begin <= :s AND begin > :l", t=t.id, s=at, l=low)
    touched = {r["file_id"] for r in (*rows, *small) if file_ids is None or r["file_id"] in file_ids}
    out: DataFrame | None = None
    used = {r["delete_id"] for r in rows if r["file_id"] in touched}
    if used:
        known = [r for r in cat.rows("SELECT * FROM delete_file WHERE table_id = :t", t=t.id) if r["id"] in used]
        for begin in sorted({r["begin"] for r in known}):
            df = spark.read.schema("_file_id long, _pos long").parquet(*[r["path"] for r in known if r["begin"] == begin]).withColumn("_deleted_at", F.lit(begin).cast("long"))
            out = df if out is None else out.unionByName(df)
    few = [(r["file_id"], r["pos"], r["begin"]) for r in small if r["file_id"] in touched]
    if few:
        df = spark.createDataFrame(few, "_file_id long, _pos long, _deleted_at long")
        out = df if out is None else out.unionByName(df)
    return out, touched


def inlined(lake: Lake, cat: Catalog, t: Table, condition: str, args: dict, fields: list[dict] | None = None, meta: bool = False, stop: bool = False) -> DataFrame | None:
    """Rows kept in the catalog, under the schema of now."""
    from .lake import unpacked

    fields = fields or t.fields
    out: DataFrame | None = None
    rows = cat.rows(f"SELECT * FROM inlined WHERE table_id = :t AND {condition} ORDER BY row_id, begin", t=t.id, **args)
    for version in sorted({r["schema_version"] for r in rows}):
        own = [r for r in rows if r["schema_version"] == version]
        old = fields_at(cat, t.id, version)
        meta_schema = T._parse_datatype_string(_META_SCHEMA + ", _stop long").fields
        data = [(*unpacked(r["data"]), -1, r["row_id"], r["row_id"], r["begin"], r["stop"]) for r in own]
        df = lake.spark.createDataFrame(data, T.StructType([*schema.plain_schema(old).fields, *meta_schema]), verifySchema=False)
        df = schema.project(df, old, fields, [*META, "_stop"])
        df = df if stop else df.drop("_stop")
        df = df if meta else df.drop(*META)
        out = df if out is None else out.unionByName(df)
    return out


def alive(lake: Lake, cat: Catalog, t: Table, rows: list[sqlite3.Row], at: int, meta: bool) -> DataFrame:
    """Rows of the files that aren't deleted at the snapshot."""
    gone, touched = deleted(lake, cat, t, at, {r["id"] for r in rows})
    # A compacted file may hold rows that came later than an older snapshot.
    special = [r for r in rows if r["id"] in touched or (r["partial_max"] or 0) > at]
    plain = [r for r in rows if r["id"] not in touched and (r["partial_max"] or 0) <= at]
    if not special:
        return read_files(lake, cat, t, plain, meta)
    df = read_files(lake, cat, t, special, True).filter(F.col("_snapshot_id") <= at)
    if gone is not None:
        df = df.join(gone.select("_file_id", "_pos"), ["_file_id", "_pos"], "left_anti")
    df = df.select(*[F.col(f"`{f['name']}`") for f in t.fields], *(META if meta else []))
    return df.unionByName(read_files(lake, cat, t, plain, meta)) if plain else df


def table(lake: Lake, t: Table, at: int, where: str | Expression | None = None, meta: bool = False, alias: str | None = None) -> DataFrame:
    cat = lake._c
    out = alive(lake, cat, t, live_files(lake, cat, t, at, where), at, meta)
    own = inlined(lake, cat, t, VISIBLE, {"s": at}, meta=meta)
    if own is not None:
        out = out.unionByName(own)
    out = out.alias(alias) if alias else out
    return out.filter(column(where)) if where else out

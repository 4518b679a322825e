"""INSERT, and the registration of files that are there already."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError, ConstraintError, InvalidInput
from ..functions import transforms
from ..sources import files, schema
from ..sources.catalog import Catalog
from ..sources.lake import _order, as_bytes, packed

if TYPE_CHECKING:
    from ..sources.lake import Lake, Table, Transaction

_BROKEN = "NOT NULL constraint failed: "


def conform(df: DataFrame, t: Table, columns: list[str] | None) -> DataFrame:
    """The table's columns from those given (by place, or for `columns`), defaults for the rest."""
    names = columns if columns is not None else [f["name"] for f in t.fields]
    if len(df.columns) != len(names):
        raise InvalidInput(f"the table has {len(names)} columns, the rows have {len(df.columns)}")
    df = df.toDF(*[f"_c{k}" for k in range(len(names))])
    place = {n.lower(): k for k, n in enumerate(names)}
    if unknown := set(place) - {f["name"].lower() for f in t.fields}:
        raise CatalogError(f"no such columns: {sorted(unknown)}")
    out = []
    for f in t.fields:
        want = schema.field_type(f)
        if f["name"].lower() in place:
            c = F.col(f"_c{place[f['name'].lower()]}")
            have = df.schema[f"_c{place[f['name'].lower()]}"].dataType
            c = c if have == want else c.cast(want)
        else:
            c = F.expr(f["default"]).cast(want) if f["default"] is not None else F.lit(None).cast(want)
        if f["type"] in schema.RANGES:
            low, high = schema.RANGES[f["type"]]
            c = F.when(c.isNull() | c.between(low, high), c).otherwise(F.raise_error(F.lit(f"{f['name']}: out of range of {f['type']}")))
        out.append(c.alias(f["name"]))
    return df.select(*out)


def options(lake: Lake, t: Table) -> dict[str, str]:
    out = {"compression": lake.option("parquet_compression", t)}
    if size := lake.option("parquet_row_group_size_bytes", t):
        out["parquet.block.size"] = str(as_bytes(size))
    if rows := lake.option("parquet_row_group_size", t):
        out["parquet.block.row.count.limit"] = rows
    if level := lake.option("parquet_compression_level", t):
        out["parquet.compression.codec.zstd.level"] = out["zlib.compress.level"] = level
    out["parquet.writer.version"] = "PARQUET_2_0" if lake.option("parquet_version", t).lower().lstrip("v") == "2" else "PARQUET_1_0"
    return out


def _demanded(c: Column, f: dict, path: str) -> list[tuple[str, Column]]:
    """What NOT NULL asks of a column without statistics, and of fields in structs: (name, whether it is broken)."""
    kind = schema.field_type(f)
    out = [(path, c.isNull())] if not f["nullable"] and ("." in path or not isinstance(kind, T.AtomicType) or isinstance(kind, T.BinaryType)) else []
    if isinstance(kind, T.StructType):
        for x in f["children"]:
            out += [(n, c.isNotNull() & broken) for n, broken in _demanded(c.getField(x["name"]), x, f"{path}.{x['name']}")]
    return out


def key_columns(t: Table) -> list[tuple[str, Any]]:
    by_id = {f["id"]: f for f in t.fields}
    out = []
    for k, spec in enumerate(t.keys):
        f = by_id[spec["field"]]
        name = f"_p{k}_{f['name'] if spec['transform'] == 'identity' else spec['transform'] + '_' + f['name']}"
        out.append((name, transforms.apply(spec["transform"], spec["arg"], F.col(f"`{f['name']}`"), schema.field_type(f)).cast("string")))
    return out


def write_files(lake: Lake, tx: Transaction, t: Table, df: DataFrame, embeds: bool = False, sort: bool = True) -> list[dict]:
    """Files of the table's layout from rows in the table's columns (with embeds: also _row_id and _snapshot_id)."""
    names = [f["name"] for f in t.fields]
    typed = lake.spark.createDataFrame([], schema.schema(t.fields)).schema
    # Field ids go into the files' schema with the columns' metadata.
    cols = []
    for f, own in zip(typed.fields, t.fields, strict=True):
        c = F.col(f"`{f.name}`")
        for n, broken in _demanded(c, own, f.name):
            c = F.when(broken, F.raise_error(F.lit(f"{_BROKEN}{t.name}.{n}."))).otherwise(c)
        cols.append(c.alias(f.name, metadata=f.metadata))
    df = df.select(*cols, *(["_row_id", "_snapshot_id"] if embeds else []))
    keys = key_columns(t)
    if t.sort and sort:
        df = df.sort(*[_order(k) for k in t.sort])
    kept = lake._c.one("SELECT rows, bytes FROM table_stats WHERE table_id = :t", t=t.id)
    width = kept["bytes"] // kept["rows"] if kept is not None and kept["rows"] > 0 else 0
    try:
        made = files.write(df, t.path, keys, options(lake, t), as_bytes(lake.option("target_file_size", t)), width)
    except Exception as e:
        if m := re.search(rf"{_BROKEN}(.*?)\.(?=\W|$)", str(e)):
            raise ConstraintError(f"{_BROKEN}{m[1]}") from e
        raise
    tx.written += [m["path"] for m in made]
    by_name = {f["name"]: f for f in t.fields}
    for m in made:
        m["stats"] = {by_name[n]["id"]: s for n, s in m["stats"].items() if n in by_name}
        for f in t.fields:
            if not f["nullable"] and (m["stats"].get(f["id"], (0, 0))[1] or 0) > 0:
                raise ConstraintError(f"{_BROKEN}{t.name}.{f['name']}")
    assert len(names) == len(by_name)
    return made


def register(cat: Catalog, s: int, t: Table, made: list[dict], ids: list[int], embeds: bool = False, origin: str = "insert", begin: int | None = None, partial_max: int | None = None, fresh: bool = True, mapping: int | None = None, nan: int = 0) -> None:
    """Files as part of the table from snapshot s on; `fresh` rows get row ids and count as new."""
    stats = cat.one("SELECT * FROM table_stats WHERE table_id = :t", t=t.id)
    next_row, rows, size = stats["next_row_id"], 0, 0
    version = cat.one("SELECT version FROM tbl_schema WHERE table_id = :t AND stop IS NULL", t=t.id)["version"]
    for i, m in zip(ids, made, strict=True):
        cat.run(
            "INSERT INTO data_file VALUES (:id, :t, :b, NULL, :path, :rows, :bytes, :start, :v, :p, :pm, :map, :e, :o)",
            id=i, t=t.id, b=s if begin is None else begin, path=m["path"], rows=m["rows"], bytes=m["bytes"], start=next_row if fresh else -1, v=m.get("version", version if fresh else t.version), p=t.partition_id, pm=partial_max, map=m.get("mapping", mapping), e=int(embeds), o=origin,
        )
        cat.many("INSERT INTO file_stats VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(i, t.id, c, n, nulls, low, high, nan) for c, (n, nulls, low, high) in m["stats"].items()])
        cat.many("INSERT INTO file_partition VALUES (?, ?, ?, ?)", [(i, t.id, k, v) for k, v in enumerate(m["partition"])])
        if fresh:
            next_row += m["rows"]
        rows, size = rows + m["rows"], size + m["bytes"]
    cat.run("UPDATE table_stats SET rows = rows + :r, next_row_id = :n, bytes = bytes + :b WHERE table_id = :t", r=rows, n=next_row, b=size, t=t.id)


def insert(lake: Lake, name: str, df: DataFrame, columns: list[str] | None = None) -> None:
    """Appends rows: as files, or into the catalog if they are few. The rows are computed once."""
    with lake._change() as tx:
        t = lake._table(name)
        limit = int(lake.option("data_inlining_row_limit", t))
        add_rows(lake, tx, t, conform(df, t, columns), limit)


def _inlinable(t: Table) -> bool:
    def flat(f: dict) -> bool:
        return f["type"] not in ("geometry", "variant") and all(map(flat, f["children"]))

    return all(map(flat, t.fields)) and not any(f["name"].startswith("_") for f in t.fields)


def add_rows(lake: Lake, tx: Transaction, t: Table, df: DataFrame, limit: int, embeds: bool = False, kind: str = "insert") -> None:
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    known = not embeds and _inlinable(t) and most.isDefined() and most.get() <= limit and all(f["nullable"] for f in t.fields)  # so few that they need no files
    made = [] if known else write_files(lake, tx, t, df, embeds, sort=lake.option("sort_on_insert", t) == "true")
    total = sum(m["rows"] for m in made)
    if not total and not known:
        return
    if total <= limit and _inlinable(t):
        if not known:
            df = lake.spark.read.schema(T.StructType([*schema.plain_schema(t.fields).fields, *([T.StructField("_row_id", T.LongType())] if embeds else [])])).parquet(*[m["path"] for m in made])
        rows = [tuple(r) for r in df.collect()]  # no more than the limit
        if not rows:
            return
        for m in made:
            files.remove(lake.spark, m["path"])

        def keep(c: Catalog, s: int) -> None:
            first = c.one("SELECT next_row_id FROM table_stats WHERE table_id = :t", t=t.id)["next_row_id"]
            width = len(t.fields)
            data = [(t.id, r[width] if embeds else first + k, s, t.version, packed(r[:width])) for k, r in enumerate(rows)]
            c.many("INSERT INTO inlined VALUES (?, ?, ?, NULL, ?, ?)", data)
            c.run("UPDATE table_stats SET rows = rows + :n, next_row_id = next_row_id + :m WHERE table_id = :t", n=len(rows), m=0 if embeds else len(rows), t=t.id)

        tx.add("inlined_insert", t.id, keep)
        return
    ids = list(range(first := lake._cat.take("file", len(made)), first + len(made)))
    tx.add("inserted_into_table", t.id, lambda c, s: register(c, s, t, made, ids, embeds=embeds, origin=kind))


def add_files(lake: Lake, name: str, paths: list[str], allow_missing: bool, ignore_extra: bool, hive: bool | None) -> int:
    """Makes Parquet files part of the table where they are. Columns are found by name, hive values from the path."""
    spark = lake.spark
    found: list[tuple[str, int]] = []
    for p in dict.fromkeys(paths):
        fs, hp = files.hadoop(spark, p)
        for st in fs.globStatus(hp) or []:
            found += [(x, size) for x, size, _ in files.listing(spark, st.getPath().toString())] if st.isDirectory() else [(st.getPath().toString(), st.getLen())]
    found = sorted(set(found))
    if not found:
        raise InvalidInput(f"no files at {paths}")
    with lake._change() as tx:
        t = lake._table(name)
        own = {f["name"].lower(): f for f in t.fields}
        made: list[dict] = []
        mappings: dict[str, int] = {}
        # Schemas by several threads, statistics of all files at once, and one job for all values of paths and of keys.
        with ThreadPoolExecutor(8) as pool:
            schemas = list(pool.map(lambda x: spark.read.parquet(x[0]).schema.fields, found))
        known = files.footers(spark, [p for p, _ in found], schema.plain_schema(t.fields))
        values_of = [{k: files.unescape(v) for k, v in (x.split("=", 1) for x in p.split("/")[:-1] if "=" in x)} if hive is not False else {} for p, _ in found]
        read = {(n.lower(), v) for parts in values_of for n, v in parts.items() if n.lower() in own}
        sound = _evaluated(lake, {x: F.lit(x[1]).try_cast(schema.field_type(own[x[0]])).isNotNull() | F.lit(x[1] is None) for x in read})  # "true" or "false"
        wanted: dict[tuple, Column] = {}
        for (path, size), fields, parts in zip(found, schemas, values_of, strict=True):
            kinds = {f.name: f.dataType for f in fields}
            mapping: dict[str, dict] = {}
            for n, t_file in kinds.items():
                f = own.get(n.lower())
                if f is None:
                    if not ignore_extra:
                        raise InvalidInput(f'{path}: the table has no column "{n}"; see ignore_extra_columns')
                    continue
                _readable(path, t_file, f)
                mapping[str(f["id"])] = {"column": n}
            for n, v in parts.items():
                f = own.get(n.lower())
                if f is not None and str(f["id"]) not in mapping:
                    if sound[n.lower(), v] != "true":
                        raise InvalidInput(f"{path}: {v} is not a value of {n}")
                    mapping[str(f["id"])] = {"value": v}
            if missing := [f["name"] for f in t.fields if str(f["id"]) not in mapping]:
                if not allow_missing:
                    raise InvalidInput(f"{path}: columns {missing} are missing; see allow_missing")
            rows, stats = known[path]
            key = json.dumps(mapping, sort_keys=True)
            mappings.setdefault(key, lake._cat.take("object"))
            col = {v["column"]: int(k) for k, v in mapping.items() if "column" in v}
            own_stats = {col[n]: s for n, s in stats.items() if n in col}
            for k, v in mapping.items():
                if "value" in v:
                    own_stats[int(k)] = (rows, rows if v["value"] is None else 0, v["value"], v["value"])
            values = []
            for spec in t.keys:
                f = next(x for x in t.fields if x["id"] == spec["field"])
                s = own_stats.get(f["id"])
                if s is None or s[2] is None or s[2] != s[3]:
                    raise InvalidInput(f"{path}: more than one value, or none known, of the partition key {spec['text']}")
                values.append((spec["text"], s[2]))
                wanted[values[-1]] = transforms.apply(spec["transform"], spec["arg"], F.lit(s[2]).cast(schema.field_type(f)), schema.field_type(f)).cast("string")
            made.append({"path": path, "bytes": size, "rows": rows, "stats": own_stats, "partition": values, "mapping": mappings[key]})
        keys = _evaluated(lake, wanted)
        for m in made:
            m["partition"] = [keys[v] for v in m["partition"]]
        ids = list(range(first := lake._cat.take("file", len(made)), first + len(made)))

        def step(c: Catalog, s: int) -> None:
            for key, i in mappings.items():
                c.run("INSERT INTO mapping VALUES (:i, :t, :m)", i=i, t=t.id, m=key)
            register(c, s, t, made, ids, origin="added", nan=1)

        tx.add("inserted_into_table", t.id, step)
    return len(made)


def _evaluated(lake: Lake, of: dict[Any, Column]) -> dict[Any, Any]:
    """Constant expressions as text, a thousand in a job."""
    names, out = list(of), {}
    for k in range(0, len(names), 1000):
        out |= dict(zip(names[k : k + 1000], lake.spark.range(1).select(F.array(*[of[n].cast("string") for n in names[k : k + 1000]])).first()[0], strict=True))
    return out


def _readable(path: str, have: T.DataType, f: dict) -> None:
    want = schema.field_type(f)
    if have == want or isinstance(have, T.StructType | T.ArrayType | T.MapType) and type(have) is type(want):
        return
    try:
        ok = schema.widens(schema.type_name(have), f["type"]) or f["type"] in schema.RANGES or {schema.type_name(have), f["type"]} <= {"timestamp", "timestamptz"}
    except NotImplementedError:
        ok = False
    if not ok or f["type"] in ("float64", "float32") and not isinstance(have, T.FloatType | T.DoubleType):
        raise InvalidInput(f"{path}: {f['name']} is {have.simpleString()}, the table has {f['type']}")

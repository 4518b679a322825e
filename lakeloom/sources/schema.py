"""Columns with stable ids: type names, evolution of nested columns, and reading files of older schemas.

A table's columns are a list of fields, plain dictionaries so that the catalog can keep them as JSON:
id, name, type (a name, or struct / list / map), nullable, children, initial (value of rows written before the field
was there), default (SQL for new rows) and comment.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError, InvalidInput, NotSupported

# Type names of the format and the Spark types that hold them.
TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "int128": T.DecimalType(38, 0),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "uint128": T.DecimalType(38, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "time": T.LongType(), "time_ns": T.LongType(), "timetz": T.LongType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamp_us": T.TimestampNTZType(), "timestamp_ms": T.TimestampNTZType(), "timestamp_s": T.TimestampNTZType(), "timestamp_ns": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "timestamptz_ns": T.TimestampType(), "interval": T.DayTimeIntervalType(), "varchar": T.StringType(), "blob": T.BinaryType(),
    "uuid": T.StringType(), "json": T.StringType(), "variant": T.VariantType(), "geometry": T.BinaryType(),
}
# Ranges of the types that Spark holds in a wider one.
RANGES = {"uint8": (0, 255), "uint16": (0, 65_535), "uint32": (0, 4_294_967_295), "uint64": (0, 18_446_744_073_709_551_615), "uint128": (0, 10**38 - 1)}
_NAMES = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "varchar", "binary": "blob", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "boolean": "boolean", "date": "date", "variant": "variant"}
#: Widening: a type and those that hold all its values, nearest first.
WIDER = {
    "int8": "int16 int32 int64 int128 float32 float64", "int16": "int32 int64 int128 float32 float64", "int32": "int64 int128 float64", "int64": "int128 float64",
    "uint8": "uint16 uint32 uint64 int16 int32 int64 int128 float32 float64", "uint16": "uint32 uint64 int32 int64 int128 float32 float64", "uint32": "uint64 int64 int128 float64", "uint64": "int128 float64",
    "float32": "float64", "date": "timestamp timestamptz", "timestamp_s": "timestamp_ms timestamp timestamp_us timestamp_ns", "timestamp_ms": "timestamp timestamp_us timestamp_ns", "timestamp": "timestamp_ns timestamptz", "json": "varchar", "uuid": "varchar",
}
_DECIMAL = re.compile(r"decimal\((\d+),\s*(-?\d+)\)")


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, T.DayTimeIntervalType):
        return "interval"
    name = _NAMES.get(t.simpleString())
    if name is None:
        raise NotSupported(f"type {t.simpleString()} is not supported")
    return name


def spark_type(name: str) -> T.DataType:
    if m := _DECIMAL.fullmatch(name):
        return T.DecimalType(int(m[1]), int(m[2]))
    if name not in TYPES:
        raise NotSupported(f"type {name} is not supported")
    return TYPES[name]


def widens(old: str, new: str) -> bool:
    if old == new or new in WIDER.get(old, "").split():
        return True
    a, b = _DECIMAL.fullmatch(old), _DECIMAL.fullmatch(new)
    if a and b:
        return int(b[2]) >= int(a[2]) and int(b[1]) - int(b[2]) >= int(a[1]) - int(a[2])
    digits = {"int8": 3, "int16": 5, "int32": 10, "int64": 19}
    return bool(b and old in digits and int(b[1]) - int(b[2]) >= digits[old] or a and new == "float64")


class Ids:
    """Field ids of a table: from 1, never used again."""

    def __init__(self, last: int = 0):
        self.last = last

    def next(self) -> int:
        self.last += 1
        return self.last


def from_spark(f: T.StructField, ids: Ids) -> dict:
    out = {"id": ids.next(), "name": f.name, "nullable": f.nullable, "initial": None, "default": f.metadata.get("default"), "comment": f.metadata.get("comment")}
    t = f.dataType
    if isinstance(t, T.StructType):
        if not t.fields:
            raise NotSupported("a struct needs at least one field")
        out |= {"type": "struct", "children": [from_spark(c, ids) for c in t.fields]}
    elif isinstance(t, T.ArrayType):
        out |= {"type": "list", "children": [from_spark(T.StructField("element", t.elementType), ids)]}
    elif isinstance(t, T.MapType):
        out |= {"type": "map", "children": [from_spark(T.StructField("key", t.keyType), ids), from_spark(T.StructField("value", t.valueType), ids)]}
    else:
        out |= {"type": f.metadata.get("lake_type") or type_name(t), "children": []}
    if out["default"] is not None and out["children"]:
        raise NotSupported("a nested column has no default")
    return out


def new_fields(schema: T.StructType, ids: Ids) -> list[dict]:
    names = [f.name.lower() for f in schema.fields]
    if not names or len(set(names)) < len(names):
        raise CatalogError("columns must have distinct names")
    for f in schema.fields:
        if f.metadata.get("unsupported"):
            raise NotSupported(f"{f.metadata['unsupported']} constraints are not supported")
    return [from_spark(f, ids) for f in schema.fields]


def field_type(f: dict) -> T.DataType:
    kids = f["children"]
    if f["type"] == "struct":
        return T.StructType([struct_field(c) for c in kids])
    if f["type"] == "list":
        return T.ArrayType(field_type(kids[0]))
    if f["type"] == "map":
        return T.MapType(field_type(kids[0]), field_type(kids[1]))
    return spark_type(f["type"])


def struct_field(f: dict, ids: bool = True) -> T.StructField:
    meta = {"parquet.field.id": f["id"]} if ids else {}
    if f.get("comment"):
        meta["comment"] = f["comment"]
    return T.StructField(f["name"], field_type(f), True, meta)


def schema(fields: list[dict]) -> T.StructType:
    return T.StructType([struct_field(f) for f in fields])


def plain_schema(fields: list[dict]) -> T.StructType:
    """Without ids: what readers and users see."""
    strip = lambda t: T.StructType([T.StructField(f.name, strip(f.dataType), f.nullable) for f in t.fields]) if isinstance(t, T.StructType) else T.ArrayType(strip(t.elementType)) if isinstance(t, T.ArrayType) else T.MapType(strip(t.keyType), strip(t.valueType)) if isinstance(t, T.MapType) else t
    return strip(schema(fields))


def find(fields: list[dict], path: str | list[str]) -> dict:
    parts = path.split(".") if isinstance(path, str) else path
    level, out = fields, None
    for p in parts:
        out = next((f for f in level if f["name"].lower() == p.lower()), None)
        if out is None:
            raise CatalogError(f'column "{".".join(parts)}" does not exist')
        level = out["children"]
    return out


def top_id(fields: list[dict]) -> int:
    return max((max(f["id"], top_id(f["children"])) for f in fields), default=0)


def literal(value: object, t: T.DataType) -> Column:
    return F.lit(value).cast(t) if value is not None else F.lit(None).cast(t)


def _same(a: dict, b: dict) -> bool:
    return a["type"] == b["type"] and len(a["children"]) == len(b["children"]) and all(x["id"] == y["id"] and x["name"] == y["name"] and _same(x, y) for x, y in zip(a["children"], b["children"], strict=True))


def evolved(value: Column, old: dict, new: dict) -> Column:
    """A value of the field as it was, in its form of now: by ids, with casts to wider types and initial values."""
    if _same(old, new):
        return value
    kind = new["type"]
    if kind == "struct" and old["type"] == "struct":
        own = {c["id"]: c for c in old["children"]}
        parts = [(evolved(value[own[c["id"]]["name"]], own[c["id"]], c) if c["id"] in own else literal(c["initial"], field_type(c))).alias(c["name"]) for c in new["children"]]
        return F.when(value.isNotNull(), F.struct(*parts))
    if kind == "list" and old["type"] == "list":
        return F.transform(value, lambda x: evolved(x, old["children"][0], new["children"][0]))
    if kind == "map" and old["type"] == "map":
        out = F.transform_keys(value, lambda k, v: evolved(k, old["children"][0], new["children"][0]))
        return F.transform_values(out, lambda k, v: evolved(v, old["children"][1], new["children"][1]))
    return value.cast(field_type(new))


def project(df: DataFrame, old: list[dict], new: list[dict], extra: list[str]) -> DataFrame:
    """Rows written under `old` as rows of `new`; `extra` columns go along."""
    if len(old) == len(new) and all(a["id"] == b["id"] and a["name"] == b["name"] and _same(a, b) for a, b in zip(old, new, strict=True)):
        return df
    own = {f["id"]: f for f in old}
    cols = [(evolved(F.col(f"`{own[f['id']]['name']}`"), own[f["id"]], f) if f["id"] in own else literal(f["initial"], field_type(f))).alias(f["name"]) for f in new]
    return df.select(*cols, *extra)


def _change(fields: list[dict], path: str, make: Callable[[list[dict], dict], None]) -> list[dict]:
    """A copy of the fields in which `make(siblings, field)` was applied at `path`."""
    out = copy.deepcopy(fields)
    parts = path.split(".")
    level = out if len(parts) == 1 else find(out, parts[:-1])["children"]
    if len(parts) > 1 and find(out, parts[:-1])["type"] not in ("struct", "list", "map"):
        raise CatalogError(f'"{".".join(parts[:-1])}" is not a struct')
    make(level, find(level, parts[-1:]))
    return out


def add(fields: list[dict], path: str, t: T.DataType, ids: Ids, default: object = None) -> list[dict]:
    out = copy.deepcopy(fields)
    parts = path.split(".")
    level = out
    if len(parts) > 1:
        parent = find(out, parts[:-1])
        if parent["type"] != "struct":
            raise CatalogError(f'"{parent["name"]}" is not a struct')
        level = parent["children"]
    if any(f["name"].lower() == parts[-1].lower() for f in level):
        raise CatalogError(f'column "{path}" exists already')
    if default is not None and isinstance(default, str | int | float | bool) is False:
        raise InvalidInput("the default of a new column must be a literal")
    f = from_spark(T.StructField(parts[-1], t), ids)
    f["initial"] = default
    f["default"] = json.dumps(default) if isinstance(default, int | float | bool) else None if default is None else "'" + default.replace("'", "''") + "'"
    if default is not None and f["children"]:
        raise NotSupported("a nested column has no default")
    level.append(f)
    return out


def drop(fields: list[dict], path: str) -> list[dict]:
    def go(level: list[dict], f: dict) -> None:
        if len(level) == 1:
            raise CatalogError(f'cannot drop "{path}": it is the only column')
        level.remove(f)

    return _change(fields, path, go)


def rename(fields: list[dict], path: str, name: str) -> list[dict]:
    def go(level: list[dict], f: dict) -> None:
        if any(x is not f and x["name"].lower() == name.lower() for x in level):
            raise CatalogError(f'column "{name}" exists already')
        f["name"] = name

    return _change(fields, path, go)


def _retyped(f: dict, t: T.DataType, ids: Ids) -> None:
    if isinstance(t, T.StructType) and f["type"] == "struct":
        own = {c["name"].lower(): c for c in f["children"]}
        kids = []
        for s in t.fields:
            c = own.get(s.name.lower()) or from_spark(s, ids)
            if s.name.lower() in own:
                _retyped(c, s.dataType, ids)
            kids.append(c)
        f["children"] = kids
    elif isinstance(t, T.ArrayType) and f["type"] == "list":
        _retyped(f["children"][0], t.elementType, ids)
    elif isinstance(t, T.MapType) and f["type"] == "map":
        _retyped(f["children"][0], t.keyType, ids), _retyped(f["children"][1], t.valueType, ids)
    else:
        name = None if isinstance(t, T.StructType | T.ArrayType | T.MapType) else type_name(t)
        if name is None or f["children"] or not widens(f["type"], name):
            raise CatalogError(f'cannot change "{f["name"]}" from {f["type"]} to {t.simpleString()}: only widening type promotions are allowed')
        f["type"] = name


def retype(fields: list[dict], path: str, t: T.DataType, ids: Ids) -> list[dict]:
    return _change(fields, path, lambda level, f: _retyped(f, t, ids))


def put(fields: list[dict], path: str, **values: object) -> list[dict]:
    return _change(fields, path, lambda level, f: f.update(values))

"""Partition transforms, and the 32-bit Murmur3 hash behind buckets."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput

# Fixed value: the 32-bit integer whose Spark hash is 0, so that a chain behind it starts with seed 0.
_SEED_ZERO = -1693959553


def murmur3_bytes(data: bytes, seed: int = 0) -> int:
    """Murmur3 x86 32 as a signed number."""
    m = 0xFFFFFFFF

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & m
        return ((k << 15 | k >> 17) & m) * 0x1B873593 & m

    h, whole = seed, len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h ^= scramble(k)
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    if tail := data[whole:]:
        h ^= scramble(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _let(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """Steps one after another, each with its argument computed once."""
    for step in steps:
        c = F.transform(F.array(c), step)[0]
    return c


def _times(k: int) -> Callable[[Column], Column]:
    """Unsigned product of 32 bits, by halves that no long overflows at."""
    return lambda x: (x * F.lit(k & 0xFFFF).cast("long") + F.shiftleft((x * F.lit(k >> 16).cast("long")).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _turned(r: int) -> Callable[[Column], Column]:
    return lambda x: F.shiftleft(x, r).bitwiseOR(F.shiftright(x, 32 - r)).bitwiseAND(F.lit(0xFFFFFFFF))


def _folded(*shifts: int) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        out = x
        for r in shifts:
            out = out.bitwiseXOR(F.shiftright(x, r))
        return out

    return step


def _of_bytes(data: Column) -> Column:
    """Spark's hash is this one for whole words of 4 bytes and differs at the bytes behind them only. So the last steps
    of the whole words' hash are undone, the rest mixed in, and the steps done again."""
    a, b, inverse = 0x85EBCA6B, 0xC2B2AE35, lambda k: pow(k, -1, 1 << 32)
    n = F.octet_length(data)
    rest = F.pmod(n, F.lit(4))
    whole = F.hash(F.lit(_SEED_ZERO), F.substring(data, F.lit(1), n - rest))
    byte = lambda k: F.coalesce(F.conv(F.hex(F.substring(data, n - rest + k, F.lit(1))), 16, 10).cast("long"), F.lit(0).cast("long"))
    tail = _let(byte(1) + byte(2) * 256 + byte(3) * 65536, _times(0xCC9E2D51), _turned(15), _times(0x1B873593))
    state = _let(whole.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), _folded(16), _times(inverse(b)), _folded(13, 26), _times(inverse(a)), _folded(16))
    mixed = state.bitwiseXOR((n - rest).cast("long")).bitwiseXOR(tail).bitwiseXOR(n.cast("long"))
    out = _let(mixed, _folded(16), _times(a), _folded(13), _times(b), _folded(16), lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int"))
    return F.when(rest == 0, whole).otherwise(out)


def murmur3_32(c: Column, t: T.DataType) -> Column:
    """Integers, booleans, dates, timestamps and short decimals as 8 bytes; floats by their double's bits, -0.0 as 0.0;
    strings and binaries as they are; all else by its text. Null gives null. All of it stays in the JVM."""
    if isinstance(t, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        n = c.cast("long")
    elif isinstance(t, T.DateType):
        n = F.unix_date(c).cast("long")
    elif isinstance(t, T.TimestampType):
        n = F.unix_micros(c)
    elif isinstance(t, T.TimestampNTZType):
        n = _ntz_micros(c)
    elif isinstance(t, T.DecimalType) and t.precision <= 18:
        n = (c * F.lit(10**t.scale).cast(T.DecimalType(19, 0))).cast("long")
    elif isinstance(t, T.FloatType | T.DoubleType):
        # Spark hashes a double's bits as 8 bytes, and takes -0.0 as 0.0.
        return F.when(c.isNotNull(), F.hash(F.lit(_SEED_ZERO), c.cast("double")))
    else:
        data = c if isinstance(t, T.BinaryType) else c.cast("string").cast("binary")
        return F.when(data.isNotNull(), _of_bytes(data))
    return F.when(c.isNotNull(), F.hash(F.lit(_SEED_ZERO), n))


def _ntz_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp without zone."""
    day = c.cast("date")
    return F.unix_date(day).cast("long") * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _epoch(c: Column, t: T.DataType, unit: str) -> Column:
    """Boundaries of `unit` since 1970; zoned timestamps in UTC."""
    if isinstance(t, T.TimestampType):
        seconds = F.floor(F.unix_micros(c) / 1_000_000)
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
        hour = F.floor(seconds / 3600)
    else:
        day = c.cast("date")
        hour = F.unix_date(day).cast("long") * 24 + (F.hour(c) if not isinstance(t, T.DateType) else F.lit(0))
    months = (F.year(day) - 1970) * 12 + F.month(day) - 1
    return {"year": F.year(day) - 1970, "month": months, "day": F.unix_date(day), "hour": hour}[unit].cast("long")


_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}


def check(transform: str, arg: int | None) -> None:
    known = {"identity", "bucket", *_PARTS, *(f"epoch_{u}" for u in _PARTS)}
    if transform not in known:
        raise InvalidInput(f"unsupported partition function {transform}")
    if transform == "bucket" and not (isinstance(arg, int) and 1 <= arg < 2**31):
        raise InvalidInput("bucket needs a count from 1 to 2147483647")


def apply(transform: str, arg: int | None, c: Column, t: T.DataType) -> Column:
    """The partition value of a column: calendar parts are 1-based numbers, epoch units count from 1970."""
    check(transform, arg)
    if transform == "identity":
        return c
    if transform == "bucket":
        return (murmur3_32(c, t).bitwiseAND(F.lit(0x7FFFFFFF)) % F.lit(arg)).cast("long")
    if transform.startswith("epoch_"):
        return _epoch(c, t, transform[6:])
    return _PARTS[transform](c).cast("long")


def bucket_of(value: object, n: int, t: T.DataType) -> int | None:
    """The bucket of a literal, on the driver; None where it takes a scan to know."""
    if isinstance(value, bool) or isinstance(value, int) and isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.BooleanType):
        data = struct.pack("<q", int(value))
    elif isinstance(value, str) and isinstance(t, T.StringType):
        data = value.encode()
    else:
        return None
    return (murmur3_bytes(data) & 0x7FFFFFFF) % n

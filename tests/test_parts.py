import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeloom.errors import ConflictError, InvalidInput
from lakeloom.functions import transforms
from lakeloom.operators import conflicts


def test_bucket_goldens():
    from pyspark.sql import types as T

    assert [transforms.bucket_of(x, 4, T.StringType()) for x in ("alice", "bob", "charlie")] == [1, 2, 3]
    assert transforms.bucket_of(0, 10, T.IntegerType()) == 6


def test_hash_in_the_jvm_agrees_with_bytes(spark):
    import struct

    df = spark.sql("SELECT id * 7919 - 50000 AS n, repeat(char(97 + id % 26) || 'é漢', id % 5) || cast(id AS string) AS s, id % 2 = 0 AS b, (id - 50) / 3D AS f FROM range(100)")
    cols = [transforms.murmur3_32(F.col(c), df.schema[c].dataType).alias(f"h{c}") for c in "nsbf"]
    for r in df.select("*", *cols).collect():
        assert r["hn"] == transforms.murmur3_bytes(struct.pack("<q", r["n"]))
        assert r["hs"] == transforms.murmur3_bytes(r["s"].encode())
        assert r["hb"] == transforms.murmur3_bytes(struct.pack("<q", r["b"]))
        assert r["hf"] == transforms.murmur3_bytes(struct.pack("<d", r["f"]))
    zero = spark.sql("SELECT -0.0D AS a, 0.0D AS b, CAST(NULL AS INT) AS c")
    out = zero.select(*[transforms.murmur3_32(F.col(c), zero.schema[c].dataType).alias(c) for c in "abc"]).first()
    assert out["a"] == out["b"] and out["c"] is None


def test_epoch_units_count_boundaries(spark):
    want = {"1969-12-31 23:59:59.5": (-1, -1, -1, -1), "1970-01-01 00:00:00": (0, 0, 0, 0), "2020-01-01 05:30:00": (50, 600, 18262, 438293), "1960-02-29 01:00:00": (-10, -119, -3594, -86255)}
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t),) for t in want], "t timestamp_ntz")
    got = df.select(*[transforms.apply(f"epoch_{u}", None, F.col("t"), df.schema["t"].dataType).alias(u) for u in ("year", "month", "day", "hour")]).collect()
    assert list(map(tuple, got)) == list(want.values())


def test_unknown_transforms():
    with pytest.raises(InvalidInput):
        transforms.check("truncate", 3)
    with pytest.raises(InvalidInput):
        transforms.check("bucket", 0)


def test_conflict_matrix():
    conflicts.check([["inserted_into_table", "1", None]], [["inserted_into_table", "1", None]])
    conflicts.check([["deleted_from_table", "1", [4]]], [["deleted_from_table", "1", [5]]])
    conflicts.check([["deleted_from_table", "1", [4]]], [["deleted_from_table", "2", [4]]])
    for mine, theirs in ((["deleted_from_table", "1", [4]], ["deleted_from_table", "1", [4, 5]]), (["altered_table", "1", None], ["altered_table", "1", None]), (["merge_adjacent", "1", None], ["deleted_from_table", "1", [1]]), (["created_table", "main.t", None], ["created_view", "main.t", None])):
        with pytest.raises(ConflictError):
            conflicts.check([mine], [theirs])


def test_registered_queries_have_distinct_names_and_sql():
    from lakeloom.plans import registry

    q, o = registry.queries(), registry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert set(q) - set(o) == {"murmur3_floats"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0

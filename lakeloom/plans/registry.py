"""Queries over lake tables, each with its SQL over the raw tables.

Every query builds a lake from the Parquet tables of a folder, does what it is named for, and returns what the lake
then reads. The hosted queries share one lake for each folder.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms
from ..shipping import ship
from ..sources.lake import Lake
from . import hosted

_SHARED: dict[tuple[str, str], Lake] = {}
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_lake(spark: SparkSession, **how) -> Lake:
    """Catalog in the driver's own folder, data where all executors see it."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    home = tempfile.mkdtemp(prefix="lake-")
    return Lake(spark, home, data_path=f"{shared.rstrip('/')}/lakes/{uuid.uuid4().hex}" if shared else f"{home}/data", **how)


def shared_lake(spark: SparkSession, sf_dir: str) -> Lake:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        lake = new_lake(spark)
        with lake.transaction():
            for t in hosted.TABLES:
                lake.create_table_as(t, _raw(spark, sf_dir, t))
        _SHARED[key] = lake
    return _SHARED[key]


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__.strip("_")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_lake(spark, sf_dir).sql(_spark_sql("tpch_q1"))


def _spark_sql(name: str) -> str:
    q = hosted.QUERIES[name]
    return q if isinstance(q, str) else q[0]


for _name, _q in hosted.QUERIES.items():
    _query(_q if isinstance(_q, str) else _q[1], _name)(lambda spark, sf_dir, _name=_name: shared_lake(spark, sf_dir).sql(_spark_sql(_name)))


def _orders(spark: SparkSession, sf_dir: str, parts: int = 1, **how) -> Lake:
    """A lake with `orders` at snapshot 1, and its rows by o_orderkey % parts in the snapshots after."""
    lake = new_lake(spark, **({"data_inlining_row_limit": 0} | how))
    o = _raw(spark, sf_dir, "orders")
    lake.create_table("orders", o.schema)
    for k in range(parts):
        lake.insert("orders", o.filter(F.col("o_orderkey") % parts == k))
    return lake


# Catalog


@_query("SELECT * FROM orders")
def ctas(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("orders", _raw(spark, sf_dir, "orders"))
    return lake.table("orders")


@_query("SELECT * FROM orders WHERE o_orderkey % 3 IN (0, 1)")
def attach_at(spark, sf_dir):
    lake = _orders(spark, sf_dir, 3)
    path = lake._cat.path.removesuffix("/catalog.sqlite")
    return Lake(spark, path, lake.data_path, version=3).table("orders")


@_query("SELECT * FROM orders")
def attach(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    return Lake(spark, lake._cat.path.removesuffix("/catalog.sqlite"), lake.data_path).table("orders")


@_query("SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 3")
def create_schema(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_schema("geo")
    lake.create_table_as("geo.region", _raw(spark, sf_dir, "region"))
    lake.create_table_as("nation", _raw(spark, sf_dir, "nation"))
    return lake.sql("SELECT r_name FROM geo.region UNION ALL SELECT n_name FROM main.nation WHERE n_nationkey < 3")


@_query("SELECT * FROM nation")
def drop_table(spark, sf_dir):
    """A dropped table is still there at an older version."""
    lake = new_lake(spark)
    lake.create_table_as("nation", _raw(spark, sf_dir, "nation"))
    at = lake.current_snapshot()
    lake.drop_table("nation")
    return lake.table("nation", version=at)


@_query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def create_view(spark, sf_dir):
    """A view read at a version reads its tables at it too."""
    lake = new_lake(spark, data_inlining_row_limit=0)
    o = _raw(spark, sf_dir, "orders")
    lake.create_table("orders", o.schema)
    lake.create_view("by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
    lake.insert("orders", o.filter("o_orderkey % 2 = 0"))
    at = lake.current_snapshot()
    lake.insert("orders", o.filter("o_orderkey % 2 = 1"))
    return lake.table("by_status", version=at)


@_query("SELECT n_nationkey, (n_nationkey + 5)::INT AS a, (n_nationkey + n_regionkey)::INT AS b FROM nation")
def create_macro(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("nation", _raw(spark, sf_dir, "nation"))
    lake.create_macro("plus", "a INT, b INT DEFAULT 5", "a + b")
    return lake.sql("SELECT n_nationkey, plus(n_nationkey) AS a, plus(n_nationkey, n_regionkey) AS b FROM nation")


@_query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def create_table_macro(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("nation", _raw(spark, sf_dir, "nation"))
    lake.create_macro("of_region", "k INT", table="SELECT n_name FROM nation WHERE n_regionkey = k")
    return lake.sql("SELECT n_name FROM of_region(2)")


@_query("SELECT 'n_name' AS part, 'the name' AS text UNION ALL SELECT '', 'nations'")
def comments(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("nation", _raw(spark, sf_dir, "nation"))
    lake.comment("nation", "nations")
    lake.comment("nation", "the name", column="n_name")
    return spark.createDataFrame(list(lake.comments("nation").items()), "part string, text string")


# ALTER TABLE


@_query("SELECT * FROM orders")
def alter_rename_table(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.rename_table("orders", "bestellungen")
    return lake.table("bestellungen")


@_query("SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 42 ELSE 7 END AS flag FROM orders")
def alter_add_column(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    o = _raw(spark, sf_dir, "orders")
    lake.create_table_as("orders", o.filter("o_orderkey % 2 = 0"))
    lake.add_column("orders", "flag", "int", 42)
    lake.insert("orders", o.filter("o_orderkey % 2 = 1").withColumn("flag", F.lit(7)))
    return lake.table("orders")


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def alter_drop_column(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.drop_column("orders", "o_orderpriority")
    return lake.table("orders")


@_query("SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def alter_rename_column(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.rename_column("orders", "o_orderstatus", "status")
    return lake.table("orders", where="status = 'F'")


@_query("SELECT p_partkey, p_size::BIGINT AS p_size FROM part UNION ALL SELECT 0, 5000000000")
def alter_type(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    lake.create_table_as("part", _raw(spark, sf_dir, "part").select("p_partkey", "p_size"))
    lake.set_type("part", "p_size", "bigint")
    lake.insert("part", spark.sql("SELECT 0L, 5000000000L"))
    return lake.table("part")


def _nested(spark, sf_dir) -> Lake:
    lake = new_lake(spark, data_inlining_row_limit=0)
    lake.create_table_as("t", _raw(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").cast("int").alias("i"), F.col("o_orderstatus").alias("s")).alias("x")))
    return lake


@_query("SELECT o_orderkey, o_custkey::INT AS i, o_orderstatus AS s, NULL::BIGINT AS j FROM orders")
def alter_add_field(spark, sf_dir):
    lake = _nested(spark, sf_dir)
    lake.add_column("t", "x.j", "bigint")
    return lake.table("t").select("o_orderkey", "x.i", "x.s", "x.j")


@_query("SELECT o_orderkey, o_custkey::INT AS i FROM orders")
def alter_drop_field(spark, sf_dir):
    lake = _nested(spark, sf_dir)
    lake.drop_column("t", "x.s")
    return lake.table("t").select("o_orderkey", "x.*")


@_query("SELECT o_orderkey, o_custkey::BIGINT AS number, o_orderstatus AS s FROM orders")
def alter_rename_field(spark, sf_dir):
    lake = _nested(spark, sf_dir)
    lake.rename_column("t", "x.i", "number")
    lake.set_type("t", "x.number", "bigint")
    return lake.table("t").select("o_orderkey", "x.*")


@_query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'unknown'")
def alter_set_default(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("region", _raw(spark, sf_dir, "region"))
    lake.set_default("region", "r_name", "concat('un', 'known')")
    lake.insert("region", spark.sql("SELECT 9"), columns=["r_regionkey"])
    return lake.table("region")


@_query("SELECT * FROM orders")
def alter_set_not_null(spark, sf_dir):
    lake = _orders(spark, sf_dir, 2)
    lake.set_not_null("orders", "o_orderkey")
    return lake.table("orders")


@_query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def alter_partition(spark, sf_dir):
    """Files of before and after the change are read together."""
    lake = new_lake(spark, data_inlining_row_limit=0)
    o = _raw(spark, sf_dir, "orders")
    lake.create_table_as("orders", o.filter("o_orderkey % 2 = 0"))
    lake.set_partitioned_by("orders", "o_orderstatus", "year(o_orderdate)")
    lake.insert("orders", o.filter("o_orderkey % 2 = 1"))
    return lake.table("orders", where="o_orderstatus = 'F'")


@_query("SELECT * FROM customer")
def alter_sort(spark, sf_dir):
    lake = new_lake(spark)
    c = _raw(spark, sf_dir, "customer")
    lake.create_table("customer", c.schema, sorted_by=["c_acctbal DESC NULLS LAST", "lower(c_name)"])
    lake.insert("customer", c)
    return lake.table("customer")


# Scans


@_query("SELECT * FROM lineitem")
def scan_table(spark, sf_dir):
    return shared_lake(spark, sf_dir).table("lineitem")


@_query("SELECT * FROM orders WHERE o_orderkey % 3 IN (0, 1)")
def time_travel_version(spark, sf_dir):
    return _orders(spark, sf_dir, 3).sql("SELECT * FROM orders AT (VERSION => 3)")


@_query("SELECT * FROM orders WHERE o_orderkey % 3 = 0")
def time_travel_timestamp(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    o = _raw(spark, sf_dir, "orders")
    lake.create_table_as("orders", o.filter("o_orderkey % 3 = 0"))
    time.sleep(0.01)
    from ..sources.catalog import now

    at = now()
    time.sleep(0.01)
    lake.insert("orders", o.filter("o_orderkey % 3 = 1"))
    return lake.table("orders", timestamp=at)


def _changed(spark, sf_dir) -> Lake:
    """Snapshots 2 and 3 insert halves, 4 updates, 5 deletes."""
    lake = _orders(spark, sf_dir, 2)
    lake.update("orders", {"o_totalprice": "o_totalprice + 1"}, "o_orderpriority = '1-URGENT'")
    lake.delete("orders", "o_orderstatus = 'P'")
    return lake


_ROWS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_AFTER = "o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority"


@_query(f"SELECT (2 + o_orderkey % 2)::BIGINT AS snapshot_id, {_ROWS} FROM orders UNION ALL SELECT 4, {_AFTER} FROM orders WHERE o_orderpriority = '1-URGENT'")
def table_insertions(spark, sf_dir):
    return _changed(spark, sf_dir).insertions("orders", 2, 5).drop("rowid")


@_query(f"SELECT 4::BIGINT AS snapshot_id, {_ROWS} FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 5, {_AFTER} FROM orders WHERE o_orderstatus = 'P'")
def table_deletions(spark, sf_dir):
    return _changed(spark, sf_dir).deletions("orders", 2, 5).drop("rowid")


@_query(f"""SELECT 3::BIGINT AS snapshot_id, 'insert' AS change_type, {_ROWS} FROM orders WHERE o_orderkey % 2 = 1
 UNION ALL SELECT 4, 'update_preimage', {_ROWS} FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 4, 'update_postimage', {_AFTER} FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT 5, 'delete', {_AFTER} FROM orders WHERE o_orderstatus = 'P'""")
def table_changes(spark, sf_dir):
    return _changed(spark, sf_dir).changes("orders", 3, 5).drop("rowid")


@_query("SELECT * FROM nation WHERE n_nationkey < 8 AND n_nationkey <> 3")
def scan_inlined(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=10)
    n = _raw(spark, sf_dir, "nation")
    lake.create_table("nation", n.schema)
    lake.insert("nation", n.filter("n_nationkey < 8"))
    lake.delete("nation", "n_nationkey = 3")
    return lake.table("nation")


@_query("SELECT r_regionkey, r_regionkey::BIGINT AS rowid, 2::BIGINT AS snapshot_id, r_regionkey::BIGINT AS file_row_number, 0::BIGINT AS file_index, true AS named FROM region")
def virtual_columns(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    r = _raw(spark, sf_dir, "region")
    lake.create_table("region", r.schema, sorted_by=["r_regionkey"])
    lake.insert("region", r.coalesce(1))
    (name,) = (r["data_file"] for r in lake.list_files("region").collect())
    return lake.table("region", virtual=True).select("r_regionkey", "rowid", "snapshot_id", "file_row_number", "file_index", (F.col("filename") == name).alias("named"))


# Rows


@_query("SELECT * FROM orders")
def insert(spark, sf_dir):
    return _orders(spark, sf_dir, 3).table("orders")


@_query("SELECT * FROM region UNION ALL SELECT 7, 'x'")
def insert_inline(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("region", _raw(spark, sf_dir, "region"))
    lake.insert("region", spark.sql("SELECT 7, 'x'"))
    return lake.table("region")


@_query("SELECT * FROM events WHERE event_type = 'click' OR user_id % 10 = 3")
def insert_partitioned(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    e = _raw(spark, sf_dir, "events")
    lake.create_table("events", e.schema, partitioned_by=["event_type", "bucket(4, user_id)", "epoch_month(ts)"])
    lake.insert("events", e)
    return lake.table("events", where="event_type = 'click' OR user_id % 10 = 3")


@_query("SELECT * FROM part WHERE p_size BETWEEN 10 AND 12")
def insert_sorted(spark, sf_dir):
    lake = new_lake(spark)
    p = _raw(spark, sf_dir, "part")
    lake.create_table("part", p.schema, sorted_by=["p_size"])
    lake.insert("part", p)
    return lake.table("part", where="p_size BETWEEN 10 AND 12")


@_query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F') OR o_orderstatus IS NULL")
def delete(spark, sf_dir):
    lake = _orders(spark, sf_dir, 2)
    lake.delete("orders", "o_orderstatus = 'F'")
    return lake.table("orders")


@_query("SELECT * FROM orders WHERE o_orderkey % 1000 <> 5")
def delete_inlined(spark, sf_dir):
    lake = _orders(spark, sf_dir, data_inlining_row_limit=1000)
    lake.delete("orders", "o_orderkey % 1000 = 5")
    return lake.table("orders")


@_query("SELECT * FROM orders WHERE false")
def truncate(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.truncate("orders")
    return lake.table("orders")


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 1.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def update(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.update("orders", {"o_totalprice": "o_totalprice * 1.5D"}, "o_orderpriority = '1-URGENT'")
    return lake.table("orders")


@_query("SELECT c_custkey, c_name, c_nationkey, coalesce(n, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def update_from(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("customer", _raw(spark, sf_dir, "customer"))
    best = _raw(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("n"))
    lake.update("customer", {"c_acctbal": "source.n"}, "target.c_custkey = source.o_custkey", source=best)
    return lake.table("customer")


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment FROM customer")
def merge_into(spark, sf_dir):
    lake = new_lake(spark)
    c = _raw(spark, sf_dir, "customer")
    lake.create_table_as("customer", c.filter("c_custkey % 2 = 0"))
    lake.merge("customer", c.withColumn("c_acctbal", F.col("c_acctbal") + 100), ["c_custkey"]).when_matched_update().when_not_matched_insert().execute()
    return lake.table("customer")


@_query("SELECT * FROM customer WHERE c_custkey % 3 = 0")
def merge_delete_by_source(spark, sf_dir):
    lake = new_lake(spark)
    c = _raw(spark, sf_dir, "customer")
    lake.create_table_as("customer", c.filter("c_custkey % 2 = 0"))
    lake.merge("customer", c.filter("c_custkey % 3 = 0"), ["c_custkey"]).when_not_matched_insert().when_not_matched_by_source_delete().execute()
    return lake.table("customer")


@_query("SELECT * FROM orders")
def add_data_files(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("orders", _raw(spark, sf_dir, "orders").schema)
    lake.add_files("orders", f"{sf_dir}/orders.parquet")
    return lake.table("orders")


@_query("SELECT o_orderkey, o_orderstatus, 1::INT AS extra FROM orders")
def add_files_hive(spark, sf_dir):
    """Values from the path, and a column that the files lack."""
    lake = new_lake(spark)
    place = f"{lake.data_path}-elsewhere"
    _raw(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(place)
    lake.create_table("orders", "o_orderkey bigint, o_orderstatus string")
    lake.add_column("orders", "extra", "int", 1)
    lake.add_files("orders", place, allow_missing=True)
    return lake.table("orders")


@_query("SELECT * FROM orders")
def rollback(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    tx = lake.begin()
    lake.delete("orders", "o_orderstatus = 'F'")
    assert tx.steps
    lake.rollback()
    return lake.table("orders")


@_query("SELECT count(*) AS n, 3::BIGINT AS snapshots FROM orders WHERE o_orderstatus <> 'F'")
def transaction(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    with lake.transaction():
        lake.delete("orders", "o_orderstatus = 'F'")
        lake.add_column("orders", "flag", "int", 1)
        seen = lake.table("orders").filter("flag = 1").count()
    return spark.createDataFrame([(seen, lake.current_snapshot())], "n long, snapshots long")


# Transforms


@_query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, hour(o_orderdate)::BIGINT AS h FROM orders")
def transform_calendar(spark, sf_dir):
    o = _raw(spark, sf_dir, "orders")
    t = o.schema["o_orderdate"].dataType
    return o.select("o_orderkey", *[transforms.apply(u, None, F.col("o_orderdate"), t).alias(u[0]) for u in ("year", "month", "day", "hour")])


@_query("SELECT event_id, date_diff('year', TIMESTAMP '1970-01-01', ts) AS y, date_diff('month', TIMESTAMP '1970-01-01', ts) AS m, date_diff('day', TIMESTAMP '1970-01-01', ts) AS d, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS h FROM events")
def transform_epoch(spark, sf_dir):
    e = _raw(spark, sf_dir, "events")
    t = e.schema["ts"].dataType
    return e.select("event_id", *[transforms.apply(f"epoch_{u}", None, F.col("ts"), t).alias(u[0]) for u in ("year", "month", "day", "hour")])


def _murmur_sql(words: str, tail: str, length: str) -> str:
    """The hash in the check's SQL: of a list of unsigned words, the bytes behind them as a number, and the length in bytes."""

    def scrambled(k: str) -> str:
        x = f"({k} * 3432918353::UBIGINT % 4294967296::UBIGINT)"
        return f"(({x} * 32768::UBIGINT % 4294967296::UBIGINT + {x} // 131072::UBIGINT) * 461845907::UBIGINT % 4294967296::UBIGINT)"

    def mixed(h: str, k: str) -> str:
        x = f"xor({h}, {k})"
        return f"((({x} * 8192::UBIGINT % 4294967296::UBIGINT + {x} // 524288::UBIGINT) * 5::UBIGINT + 3864292196::UBIGINT) % 4294967296::UBIGINT)"

    h = f"list_reduce(list_prepend(0::UBIGINT, list_transform({words}, lambda k: {scrambled('k')})), lambda h, k: {mixed('h', 'k')})"
    h = f"[xor(xor({h}, {scrambled(f'({tail})::UBIGINT')}), ({length})::UBIGINT)]"
    for shift, factor in ((65536, 2246822507), (8192, 3266489909), (65536, 1)):
        h = f"list_transform({h}, lambda x: xor(x, x // {shift}::UBIGINT) * {factor}::UBIGINT % 4294967296::UBIGINT)"
    return f"list_transform({h}, lambda x: CASE WHEN x >= 2147483648 THEN x::BIGINT - 4294967296 ELSE x::BIGINT END)[1]::INT"


def _of_number(n: str) -> str:
    u = f"({n})::UBIGINT"
    return _murmur_sql(f"[{u} % 4294967296::UBIGINT, {u} // 4294967296::UBIGINT]", "0", "8")


def _of_ascii(s: str) -> str:
    byte = lambda at: f"ord(substr({s}, ({at})::BIGINT, 1))::UBIGINT"
    word = " + ".join(f"{byte(f'4 * i + {k + 1}')} * {256**k}::UBIGINT" for k in range(4))
    tail = " + ".join(f"CASE WHEN length({s}) % 4 > {k} THEN {byte(f'length({s}) // 4 * 4 + {k + 1}')} * {256**k}::UBIGINT ELSE 0::UBIGINT END" for k in range(3))
    return _murmur_sql(f"list_transform(range(length({s}) // 4), lambda i: {word})", tail, f"length({s})")


@_query("SELECT c_custkey, " + ", ".join(f"(({h})::BIGINT & 2147483647) % 16 AS b_{n}" for n, h in (("c_custkey", _of_number("c_custkey")), ("c_nationkey", _of_number("c_nationkey")), ("c_name", _of_ascii("c_name")), ("c_mktsegment", _of_ascii("c_mktsegment")))) + " FROM customer")
def transform_bucket(spark, sf_dir):
    c = _raw(spark, sf_dir, "customer")
    return c.select("c_custkey", *[transforms.apply("bucket", 16, F.col(n), c.schema[n].dataType).alias(f"b_{n}") for n in ("c_custkey", "c_nationkey", "c_name", "c_mktsegment")])


@_query(f"SELECT event_id, {_of_number('event_id')} AS h_event_id, {_of_number('epoch_us(ts)')} AS h_ts, {_of_ascii('event_type')} AS h_event_type, {_of_ascii('props')} AS h_props FROM events")
def murmur3_32(spark, sf_dir):
    e = _raw(spark, sf_dir, "events")
    return e.select("event_id", *[transforms.murmur3_32(F.col(n), e.schema[n].dataType).alias(f"h_{n}") for n in ("event_id", "ts", "event_type", "props")])


@_query()
def murmur3_floats(spark, sf_dir):
    """By the bits of doubles, which the check's SQL can't read."""
    e = _raw(spark, sf_dir, "events")
    return e.select("event_id", transforms.murmur3_32(F.col("value"), e.schema["value"].dataType).alias("h_value"))


# Metadata and maintenance


@_query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 1), (2, 1), (3, 1), (4, 2)) AS t(snapshot_id, schema_version)")
def snapshots(spark, sf_dir):
    lake = _orders(spark, sf_dir, 2)
    lake.add_column("orders", "flag", "int")
    return lake.snapshots().select("snapshot_id", "schema_version")


@_query("SELECT 'orders' AS table_name, 2::BIGINT AS file_count, 1::BIGINT AS delete_file_count")
def table_info(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    o = _raw(spark, sf_dir, "orders").coalesce(1)
    lake.create_table("orders", o.schema)
    for k in (0, 1):
        lake.insert("orders", o.filter(f"o_orderkey % 2 = {k}"))
    lake.delete("orders", "o_orderstatus = 'F'")
    return lake.table_info().select("table_name", "file_count", "delete_file_count")


@_query("SELECT count(*) AS record_count FROM orders WHERE o_orderstatus = 'F'")
def list_files(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    o = _raw(spark, sf_dir, "orders")
    lake.create_table("orders", o.schema, partitioned_by=["o_orderstatus"])
    lake.insert("orders", o)
    return lake.list_files("orders", where="o_orderstatus = 'F'").agg(F.sum("record_count").alias("record_count"))


@_query("SELECT 'data_inlining_row_limit' AS option_name, '0' AS value UNION ALL SELECT 'parquet_compression', 'zstd'")
def options(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.set_option("parquet_compression", "zstd", table="orders")
    return lake.options().filter("option_name NOT IN ('version', 'data_path')").select("option_name", "value")


@_query("SELECT * FROM orders WHERE o_orderkey % 5 < 2")
def merge_adjacent_files(spark, sf_dir):
    """An older version still reads from the merged file."""
    lake = _orders(spark, sf_dir, 5)
    lake.merge_adjacent_files("orders")
    lake.cleanup_old_files(cleanup_all=True)
    return lake.table("orders", version=3)


@_query("SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def rewrite_data_files(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete("orders", "o_orderstatus = 'F'")
    lake.rewrite_data_files("orders", delete_threshold=0.1)
    return lake.table("orders")


@_query("SELECT * FROM nation WHERE n_nationkey < 9 AND n_nationkey <> 4")
def flush_inlined_data(spark, sf_dir):
    lake = new_lake(spark)
    n = _raw(spark, sf_dir, "nation")
    lake.create_table("nation", n.schema)
    lake.insert("nation", n.filter("n_nationkey < 9"))
    lake.delete("nation", "n_nationkey = 4")
    lake.flush_inlined_data("nation")
    return lake.table("nation")


@_query("SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def expire_snapshots(spark, sf_dir):
    lake = _orders(spark, sf_dir, 3)
    lake.delete("orders", "o_orderstatus = 'F'")
    lake.expire_snapshots(versions=[1, 2, 3])
    lake.cleanup_old_files(cleanup_all=True)
    lake.delete_orphaned_files(cleanup_all=True)
    return lake.table("orders")


@_query("SELECT * FROM orders WHERE o_orderkey % 4 <> 1")
def checkpoint(spark, sf_dir):
    lake = _orders(spark, sf_dir, 4)
    lake.delete("orders", "o_orderkey % 4 = 1")
    lake.checkpoint()
    return lake.table("orders")


@_query("SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def min_max_count(spark, sf_dir):
    """From the catalog alone."""
    lake = _orders(spark, sf_dir, 2)
    low, high = lake.min_max("orders", "o_orderkey")
    return spark.createDataFrame([(lake.count("orders"), low, high)], "n long, low long, high long")


@_query("SELECT * FROM events ORDER BY event_id DESC LIMIT 10")
def top_n(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    e = _raw(spark, sf_dir, "events")
    lake.create_table("events", e.schema, sorted_by=["event_id"])
    lake.insert("events", e)
    return lake.top_n("events", "event_id", 10)


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def zone_map_pruning(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=0)
    o = _raw(spark, sf_dir, "orders")
    lake.create_table("orders", o.schema, sorted_by=["o_orderkey"])
    lake.insert("orders", o)
    return lake.table("orders", where="o_orderkey BETWEEN 100 AND 200").select("o_orderkey", "o_orderstatus")


@_query("SELECT snapshot_id, change_type, count(*) AS n FROM (SELECT 2 + o_orderkey % 2 AS snapshot_id, 'insert' AS change_type FROM orders UNION ALL SELECT 4, 'delete' FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL")
def change_stream(spark, sf_dir):
    """Two runs of the stream over new snapshots each."""
    from ..streaming.changes import ChangeStream

    lake = _orders(spark, sf_dir, 2)
    got: list[DataFrame] = []
    stream = ChangeStream(lake, "orders", f"{tempfile.mkdtemp(prefix='stream-')}/position.json")
    stream.run(lambda df, a, b: got.append(df))
    lake.delete("orders", "o_orderstatus = 'P'")
    stream.run(lambda df, a, b: got.append(df))
    return got[0].unionByName(got[1]).groupBy("snapshot_id", "change_type").agg(F.count("*").alias("n"))


@_query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def copy_from_database(spark, sf_dir):
    lake = new_lake(spark)
    lake.copy_from({t: _raw(spark, sf_dir, t) for t in ("region", "nation")})
    return lake.sql("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


# The same by SQL text


def _by_text(spark, sf_dir, *statements: str) -> Lake:
    """Statements over a lake with the customers of even keys, and all of them as `source`."""
    lake = new_lake(spark, data_inlining_row_limit=0)
    c = _raw(spark, sf_dir, "customer")
    lake.create_table_as("customer", c.filter("c_custkey % 2 = 0"))
    lake.create_table_as("source", c)
    for text in statements:
        lake.sql(text)
    return lake


@_query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NONE' END AS c_mktsegment FROM customer")
def sql_insert(spark, sf_dir):
    return _by_text(spark, sf_dir, "ALTER TABLE customer ALTER COLUMN c_mktsegment SET DEFAULT concat('NO', 'NE')", "INSERT INTO customer (c_nationkey, c_name, c_custkey) SELECT c_nationkey, c_name, c_custkey FROM source WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)").table("customer")


@_query("SELECT * FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal >= (SELECT avg(c_acctbal) FROM customer)")
def sql_delete(spark, sf_dir):
    return _by_text(spark, sf_dir, "DELETE FROM customer AS c WHERE c.c_acctbal < (SELECT avg(c_acctbal) FROM source)").table("customer")


@_query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def sql_update(spark, sf_dir):
    return _by_text(spark, sf_dir, "UPDATE customer SET c_name = c_name || '!' WHERE c_nationkey IN (SELECT c_nationkey FROM source WHERE c_acctbal > 9000)").table("customer")


@_query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 6 = 3 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def sql_merge(spark, sf_dir):
    return _by_text(spark, sf_dir, """MERGE INTO customer AS t USING (SELECT * FROM source WHERE c_custkey % 3 = 0) AS s ON t.c_custkey = s.c_custkey
 WHEN MATCHED THEN UPDATE SET c_acctbal = s.c_acctbal + t.c_acctbal WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES (s.c_custkey, s.c_name, s.c_nationkey, s.c_acctbal, 'NEW')""").table("customer")


@_query("SELECT c_mktsegment AS segment, count(*) AS n, 7::BIGINT AS flag FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_mktsegment")
def sql_ddl(spark, sf_dir):
    lake = _by_text(
        spark, sf_dir, "CREATE SCHEMA shop", "CREATE TABLE shop.people PARTITIONED BY (bucket(4, c_custkey)) AS SELECT * FROM customer", "ALTER TABLE shop.people RENAME COLUMN c_mktsegment TO segment", "ALTER TABLE shop.people ADD COLUMN flag INT DEFAULT 7",
        "ALTER TABLE shop.people ALTER COLUMN flag TYPE BIGINT", "ALTER TABLE shop.people DROP COLUMN c_name", "ALTER TABLE shop.people RENAME TO buyers", "CREATE VIEW by_segment AS SELECT segment, count(*) AS n, max(flag) AS flag FROM shop.buyers GROUP BY segment", "DROP TABLE customer",
    )
    return lake.table("by_segment")


@_query("SELECT * FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def merge_matched_delete(spark, sf_dir):
    return _by_text(spark, sf_dir, "MERGE INTO customer USING (SELECT * FROM source WHERE c_custkey % 3 = 0) AS s ON customer.c_custkey = s.c_custkey WHEN MATCHED THEN DELETE").table("customer")


@_query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE -1 END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def merge_by_source_update(spark, sf_dir):
    lake = _by_text(spark, sf_dir)
    lake.merge("customer", lake.table("source", where="c_custkey % 3 = 0"), ["c_custkey"]).when_not_matched_by_source_update({"c_acctbal": "-1"}).when_matched_do_nothing().execute()
    return lake.table("customer")


@_query("SELECT count(*) AS n FROM customer WHERE c_custkey % 2 = 0")
def rename_view(spark, sf_dir):
    return _by_text(spark, sf_dir, "CREATE VIEW v (n) AS SELECT count(*) FROM customer", "ALTER VIEW v RENAME TO w", "CREATE VIEW v AS SELECT 1", "DROP VIEW v").table("w")


@_query("SELECT 3::BIGINT AS current_id, 3::BIGINT AS committed, 'ann' AS author, 'more' AS commit_message, '{}' AS commit_extra_info")
def set_commit_message(spark, sf_dir):
    lake = _by_text(spark, sf_dir, "CALL set_commit_message('ann', 'more', '{}')", "INSERT INTO customer SELECT * FROM source WHERE c_custkey % 2 = 1")
    s = lake.snapshots().filter(F.col("snapshot_id") == lake.current_snapshot())
    return s.select(F.lit(lake.current_snapshot()).cast("long").alias("current_id"), F.lit(lake.last_committed_snapshot()).cast("long").alias("committed"), "author", "commit_message", "commit_extra_info")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

import math

import pytest

from lakeloom.errors import CatalogError, NotSupported
from lakeloom.plans import bands, parsed
from lakeloom.sources.lake import Lake


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path))


def got(lake, text):
    return sorted(tuple(r) for r in lake.sql(text).collect())


def test_rows_change_by_text(lake):
    lake.sql("CREATE TABLE t (i INT NOT NULL COMMENT 'number', s STRING DEFAULT concat('a', 'b'))")
    lake.sql("INSERT INTO t VALUES (1, 'it''s from t'), (2, NULL)")
    lake.sql("INSERT INTO t (i) SELECT i + 10 FROM t WHERE i IN (SELECT i FROM t)")
    lake.sql("WITH t AS (SELECT 99 AS i) INSERT INTO t BY NAME SELECT i FROM t")
    assert [r[0] for r in got(lake, "SELECT i FROM t")] == [1, 2, 11, 12, 99]
    assert got(lake, "UPDATE t AS k SET k.s = k.i || '!' WHERE k.i >= (SELECT max(i) FROM t) OR k.i < 2") == [(2,)]
    assert got(lake, "DELETE FROM t WHERE i BETWEEN 2 AND 11") == [(2,)]
    assert got(lake, "SELECT * FROM t;") == [(1, "1!"), (12, "ab"), (99, "99!")]
    lake.sql("CREATE TABLE u AS SELECT 1 AS i, 'one' AS s UNION ALL SELECT 7, 'seven'")
    assert got(lake, "MERGE INTO t USING (SELECT * FROM u) AS b ON t.i = b.i WHEN MATCHED AND b.i < 5 THEN UPDATE SET s = b.s || t.i WHEN NOT MATCHED THEN INSERT *") == [(2,)]
    assert got(lake, "SELECT * FROM t") == [(1, "one1"), (7, "seven"), (12, "ab"), (99, "99!")]
    assert got(lake, "MERGE INTO t USING u ON t.i = u.i WHEN MATCHED THEN DELETE") == [(2,)]
    assert got(lake, "SELECT i FROM t") == [(12,), (99,)]
    lake.sql("INSERT OVERWRITE t SELECT 5, 'five'")
    assert got(lake, "SELECT * FROM t") == [(5, "five")]
    assert got(lake, "TRUNCATE TABLE t") == [(1,)] and got(lake, "SELECT * FROM t") == []


def test_tables_change_by_text(lake):
    for text in (
        "CREATE SCHEMA g", "CREATE TABLE g.t (i INT, s STRUCT<a: INT>) PARTITIONED BY (bucket(4, i)) COMMENT 'tab'", "INSERT INTO g.t VALUES (1, named_struct('a', 2))", "ALTER TABLE g.t ADD COLUMNS (z INT DEFAULT 3, s.b STRING)",
        "ALTER TABLE g.t RENAME COLUMN z TO y", "ALTER TABLE g.t ALTER COLUMN y TYPE BIGINT", "ALTER TABLE g.t ALTER COLUMN i SET NOT NULL", "COMMENT ON COLUMN g.t.i IS 'it''s'", "ALTER TABLE g.t SET SORTED BY (i DESC, y)",
        "ALTER TABLE g.t SET PARTITIONED BY (y)", "ALTER TABLE g.t ALTER COLUMN i SET DEFAULT 8", "INSERT INTO g.t (y) VALUES (4)", "CREATE VIEW v (a) AS SELECT i + 1 FROM g.t", "ALTER VIEW v RENAME TO w", "CREATE MACRO twice(a INT) AS a * 2",
    ):
        assert lake.sql(text).collect() == []
    assert [(c, t, x) for c, t, x in got(lake, "DESCRIBE g.t")] == [("i", "int", "it's"), ("s", "struct<a:int,b:string>", None), ("y", "bigint", None)]
    assert lake.comments("g.t")[""] == "tab" and got(lake, "SHOW TABLES") == [("g", "t")]
    assert got(lake, "SELECT a, twice(a) FROM w") == [(2, 4), (9, 18)]
    assert [k["text"] for k in lake._table("g.t").keys] == ["y"] and lake._table("g.t").sort == ["i DESC", "y"]
    lake.sql("ALTER TABLE g.t RENAME TO u")
    lake.sql("DROP VIEW w")
    lake.sql("DROP MACRO twice")
    lake.sql("DROP SCHEMA g CASCADE")
    assert got(lake, "SHOW TABLES") == []
    for text in ("CREATE INDEX i ON t (x)", "CREATE SEQUENCE s", "CREATE TYPE x AS INT", "ALTER TABLE t SET TBLPROPERTIES ('a' = 'b')", "CREATE TABLE t (i INT) USING csv"):
        with pytest.raises(NotSupported):
            lake.sql(text)
    with pytest.raises(CatalogError):
        lake.sql("DELETE FROM nothing WHERE i = 1")
    lake.sql("DROP TABLE IF EXISTS nothing")


def test_transactions_and_procedures_by_text(lake):
    lake.sql("CREATE TABLE t (i INT)")
    lake.sql("CALL set_option('data_inlining_row_limit', 0, table => 't')")
    lake.sql("BEGIN TRANSACTION")
    lake.sql("INSERT INTO t VALUES (1)")
    assert got(lake, "SELECT * FROM t") == [(1,)]
    lake.sql("ROLLBACK")
    assert got(lake, "SELECT * FROM t") == []
    lake.sql("BEGIN")
    lake.sql("INSERT INTO t VALUES (1)")
    lake.sql("INSERT INTO t VALUES (2)")
    lake.sql("COMMIT")
    assert lake.current_snapshot() == 2
    lake.sql("CALL merge_adjacent_files('t')")
    assert got(lake, "SELECT * FROM t") == [(1,), (2,)] and lake.sql("CALL list_files('t')").count() == 1
    assert got(lake, "CALL current_snapshot()") == [(lake.current_snapshot(),)]


def test_names_are_bound_where_the_parser_sees_tables(lake):
    lake.sql("CREATE TABLE t AS SELECT 1 AS i")
    lake.sql("INSERT INTO t VALUES (2)")
    assert got(lake, "SELECT t.i FROM t AT (VERSION => 1)") == got(lake, "SELECT i FROM t VERSION AS OF 1 AS x") == [(1,)]
    assert got(lake, "WITH t AS (SELECT 5 AS i) SELECT i, 'from t' FROM t -- from t") == [(5, "from t")]
    assert got(lake, "WITH t AS (SELECT i + 1 AS i FROM t) SELECT * FROM t") == [(2,), (3,)]
    assert got(lake, "SELECT * FROM (WITH t AS (SELECT 0 AS i) SELECT * FROM t) a, t") == [(0, 1), (0, 2)]
    assert got(lake, "SELECT 1 FROM t x WHERE EXISTS (SELECT * FROM t WHERE t.i > x.i)") == [(1,)]
    assert got(lake, "TABLE t") == [(1,), (2,)] and got(lake, "SELECT `t`.i FROM `main`.`t` ORDER BY t.i LIMIT 1") == [(1,)]
    assert got(lake, "SELECT extract(YEAR FROM DATE '2020-02-03') AS t, count(*) FROM t JOIN t AS b USING (i)") == [(2020, 2)]


def test_references_leave_the_target_out(spark):
    tree = parsed.plan(spark, "MERGE INTO t USING u ON t.i IN (SELECT i FROM w) WHEN MATCHED THEN DELETE")
    assert {".".join(r.parts) for r in parsed.references(tree)} == {"u", "w"}


def test_default_in_values_and_explain(lake):
    lake.sql("CREATE TABLE t (i INT, s STRING DEFAULT concat('a', 'b'))")
    lake.sql("INSERT INTO t VALUES (1, DEFAULT), (1 + 1, 'x'), (DEFAULT, NULL)")
    assert sorted(got(lake, "SELECT * FROM t WHERE i > 0")) == [(1, "ab"), (2, "x")] and got(lake, "SELECT * FROM t WHERE i IS NULL") == [(None, None)]
    assert "NOT_FOUND" not in got(lake, "EXPLAIN SELECT * FROM t")[0][0]
    assert [tuple(r) for r in lake.sql("SELECT s FROM t WHERE i = :k", args={"k": 2}).collect()] == [("x",)]


def test_order_of_correlated_limits(lake):
    """Columns that only ORDER BY names decide which rows stay, in the plan too: a shuffle keeps no order."""
    lake.sql("CREATE TABLE c AS SELECT id AS k FROM range(5)")
    lake.sql("CREATE TABLE o AS SELECT id % 4 AS k, id AS i, id * 7 % 30 AS v FROM range(30)")
    want = {k: [i for _, i in sorted((-(i * 7 % 30), i) for i in range(k, 30, 4))] for k in range(4)}
    for query, rows in (
        ("SELECT c.k, t.i FROM c, LATERAL (SELECT i FROM o WHERE o.k = c.k ORDER BY v DESC, i LIMIT 1) AS t", [(k, want[k][0]) for k in range(4)]),
        ("SELECT c.k, t.i FROM c, LATERAL (SELECT i FROM o WHERE o.k = c.k ORDER BY v DESC, i LIMIT 2 OFFSET 1) AS t", [(k, i) for k in range(4) for i in want[k][1:3]]),
        ("SELECT c.k, (SELECT i FROM o WHERE o.k = c.k ORDER BY v DESC LIMIT 1) FROM c WHERE c.k < 4", [(k, want[k][0]) for k in range(4)]),
    ):
        df = lake.sql(query)
        window = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x)
        assert "row_number() windowspecdefinition" in window and "DESC" in window
        assert sorted(map(tuple, df.collect())) == sorted(rows)


@pytest.mark.parametrize("piece", [1 << 16, 5])
def test_joins_on_bands(spark, lake, monkeypatch, piece):
    """By cells, not by all pairs; with nulls, NaN, infinity, full cells, strict bounds, and a table joined with itself."""
    monkeypatch.setattr(bands, "PIECE", piece)
    values = [None, math.nan, math.inf, -math.inf, 1e17, 0.0, -0.0, *(k * 0.37 % 9 - 4 for k in range(60))]
    lake.create_table_as("a", spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, x double"))
    lake.create_table_as("b", spark.createDataFrame([(k, v) for k, v in enumerate(reversed(values + values[:20]))], "k long, y double"))
    le = lambda p, q: None not in (p, q) and (math.isnan(q) or p <= q)  # noqa: E731 - NaN is the greatest
    a, b = ([tuple(r) for r in lake.table(t).collect()] for t in ("a", "b"))
    near = sorted((i, j) for i, x in a if x is not None for j, y in b if le(x - 1, y) and le(y, x + 1))
    for query in ("SELECT a.k, b.k FROM a JOIN b ON b.y BETWEEN a.x - 1 AND a.x + 1", "SELECT a.k, b.k FROM b JOIN a ON a.x - 1 <= b.y AND 1 + a.x >= b.y"):
        df = lake.sql(query)
        assert "_y_cell" in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, df.collect())) == near
    above = sum(le(x, y) and le(y, x + 2) and x != y for _, x in a if x is not None and not math.isnan(x) for _, y in a)
    assert got(lake, "SELECT count(*) FROM a JOIN a AS c ON c.x > a.x AND c.x <= a.x + 2") == [(above,)]

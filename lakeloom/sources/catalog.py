"""The relational catalog: SQLite on the driver. Executors never see it.

Everything versioned has begin and stop: it is there at snapshot s if begin <= s and (stop is null or s < stop).
"""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
import uuid
from collections.abc import Iterable
from pathlib import Path

from ..errors import InvalidConfiguration, InvalidInput

VERSION = "1"
_DDL = """
CREATE TABLE meta(key TEXT, value TEXT, scope TEXT, scope_id INTEGER, UNIQUE(key, scope, scope_id));
CREATE TABLE counter(name TEXT PRIMARY KEY, value INTEGER);
CREATE TABLE snapshot(id INTEGER PRIMARY KEY, time TEXT, schema_version INTEGER);
CREATE TABLE change(snapshot_id INTEGER PRIMARY KEY, made TEXT, author TEXT, message TEXT, extra TEXT);
CREATE TABLE namespace(id INTEGER, begin INTEGER, stop INTEGER, name TEXT);
CREATE TABLE tbl(id INTEGER, begin INTEGER, stop INTEGER, uuid TEXT, namespace_id INTEGER, name TEXT, path TEXT);
CREATE TABLE tbl_schema(table_id INTEGER, begin INTEGER, stop INTEGER, version INTEGER, fields TEXT, last_field INTEGER);
CREATE TABLE view(id INTEGER, begin INTEGER, stop INTEGER, namespace_id INTEGER, name TEXT, sql TEXT, columns TEXT);
CREATE TABLE macro(id INTEGER, begin INTEGER, stop INTEGER, namespace_id INTEGER, name TEXT, kind TEXT, impls TEXT);
CREATE TABLE tag(object_id INTEGER, part TEXT, begin INTEGER, stop INTEGER, value TEXT);
CREATE TABLE data_file(id INTEGER PRIMARY KEY, table_id INTEGER, begin INTEGER, stop INTEGER, path TEXT, rows INTEGER, bytes INTEGER, row_id_start INTEGER,
  schema_version INTEGER, partition_id INTEGER, partial_max INTEGER, mapping_id INTEGER, embeds INTEGER, origin TEXT);
CREATE INDEX data_file_table ON data_file(table_id);
CREATE TABLE file_stats(file_id INTEGER, table_id INTEGER, column_id INTEGER, n INTEGER, nulls INTEGER, low TEXT, high TEXT, nan INTEGER);
CREATE INDEX file_stats_file ON file_stats(table_id, column_id, file_id);
CREATE TABLE delete_file(id INTEGER PRIMARY KEY, table_id INTEGER, begin INTEGER, path TEXT, rows INTEGER, bytes INTEGER);
CREATE TABLE delete_of(delete_id INTEGER, file_id INTEGER, table_id INTEGER, begin INTEGER, rows INTEGER);
CREATE INDEX delete_of_table ON delete_of(table_id);
CREATE TABLE partition_spec(id INTEGER, table_id INTEGER, begin INTEGER, stop INTEGER, keys TEXT);
CREATE TABLE file_partition(file_id INTEGER, table_id INTEGER, k INTEGER, value TEXT);
CREATE INDEX file_partition_table ON file_partition(table_id, k);
CREATE TABLE sort_spec(table_id INTEGER, begin INTEGER, stop INTEGER, keys TEXT);
CREATE TABLE inlined(table_id INTEGER, row_id INTEGER, begin INTEGER, stop INTEGER, schema_version INTEGER, data BLOB);
CREATE INDEX inlined_table ON inlined(table_id);
CREATE TABLE inlined_delete(table_id INTEGER, file_id INTEGER, pos INTEGER, begin INTEGER);
CREATE INDEX inlined_delete_table ON inlined_delete(table_id);
CREATE TABLE scheduled(path TEXT, time TEXT);
CREATE TABLE mapping(id INTEGER PRIMARY KEY, table_id INTEGER, columns TEXT);
CREATE TABLE table_stats(table_id INTEGER PRIMARY KEY, rows INTEGER, next_row_id INTEGER, bytes INTEGER);
"""
VISIBLE = "begin <= :s AND (stop IS NULL OR :s < stop)"


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="microseconds")


def moment(x: str | dt.datetime) -> str:
    """A point in time as the catalog writes it; without zone it is UTC."""
    t = dt.datetime.fromisoformat(x) if isinstance(x, str) else x
    return (t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)).isoformat(timespec="microseconds")


class Catalog:
    def __init__(self, path: str, data_path: str, create: bool = True, options: dict | None = None):
        self.path = path
        fresh = not Path(path).exists() if path != ":memory:" else True
        if fresh and not create:
            raise InvalidConfiguration(f"there is no lake at {path}")
        if fresh and path != ":memory:":
            Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.db = sqlite3.connect(path, timeout=60, isolation_level=None, check_same_thread=False)
        self.db.row_factory = sqlite3.Row
        if fresh:
            self.db.executescript("PRAGMA journal_mode=WAL;" + _DDL)
            self.db.execute("BEGIN")
            for k, v in {"version": VERSION, "data_path": data_path, "uuid": str(uuid.uuid4()), **(options or {})}.items():
                self.db.execute("INSERT INTO meta VALUES (?, ?, 'lake', 0)", (k, str(v)))
            for name, value in (("object", 1), ("file", 0)):
                self.db.execute("INSERT INTO counter VALUES (?, ?)", (name, value))
            self.db.execute("INSERT INTO snapshot VALUES (0, ?, 0)", (now(),))
            self.db.execute("INSERT INTO change VALUES (0, ?, NULL, NULL, NULL)", (json.dumps([["created_schema", "main", None]]),))
            self.db.execute("INSERT INTO namespace VALUES (0, 0, NULL, 'main')")
            self.db.execute("COMMIT")
        elif self.option("version") != VERSION:
            raise InvalidConfiguration(f"the lake at {path} has version {self.option('version')}, this engine has {VERSION}")
        elif data_path and self.option("data_path") != data_path:
            raise InvalidConfiguration(f"the lake's data path is {self.option('data_path')}, not {data_path}")

    def rows(self, sql: str, /, **args: object) -> list[sqlite3.Row]:
        return self.db.execute(sql, args).fetchall()

    def one(self, sql: str, /, **args: object) -> sqlite3.Row | None:
        return self.db.execute(sql, args).fetchone()

    def run(self, sql: str, /, **args: object) -> None:
        self.db.execute(sql, args)

    def many(self, sql: str, rows: Iterable[tuple]) -> None:
        self.db.executemany(sql, rows)

    def option(self, key: str, scope: str = "lake", scope_id: int = 0) -> str | None:
        r = self.one("SELECT value FROM meta WHERE key = :k AND scope = :c AND scope_id = :i", k=key, c=scope, i=scope_id)
        return r["value"] if r else None

    def take(self, name: str, n: int = 1) -> int:
        """The first of n numbers that nobody else gets; gaps don't matter."""
        return self.db.execute("UPDATE counter SET value = value + ? WHERE name = ? RETURNING value", (n, name)).fetchone()[0] - n

    def latest(self) -> sqlite3.Row:
        return self.one("SELECT * FROM snapshot ORDER BY id DESC LIMIT 1")

    def at(self, version: int | None = None, timestamp: str | dt.datetime | None = None, lower: bool = False) -> int:
        """The snapshot of a version, or the last one not after a point in time (with lower: the first not before)."""
        if version is not None and timestamp is not None:
            raise InvalidInput("give a version or a timestamp, not both")
        if version is not None:
            r = self.one("SELECT id FROM snapshot WHERE id = :v", v=version)
            if r is None:
                raise InvalidInput(f"No snapshot found at version {version}")
        elif timestamp is not None:
            t = moment(timestamp)
            r = self.one("SELECT id FROM snapshot WHERE time >= :t ORDER BY id LIMIT 1" if lower else "SELECT id FROM snapshot WHERE time <= :t ORDER BY id DESC LIMIT 1", t=t)
            if r is None:
                raise InvalidInput(f"No snapshot found at timestamp {t}")
        else:
            r = self.latest()
        return r["id"]

    def copy(self) -> Catalog:
        """The catalog as it is now, in memory: what an open transaction works on."""
        out = object.__new__(Catalog)
        out.path, out.db = ":memory:", sqlite3.connect(":memory:", isolation_level=None, check_same_thread=False)
        out.db.row_factory = sqlite3.Row
        self.db.backup(out.db)
        return out

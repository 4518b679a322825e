"""DELETE, UPDATE and MERGE: rows are found with their places, places become delete files, and new versions of rows
keep the ids of the old ones."""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CatalogError, ConflictError, LakeError, NotSupported
from ..plans.parsed import Expression, column
from ..sources import files, scan, schema
from ..sources.catalog import VISIBLE, Catalog
from . import write

if TYPE_CHECKING:
    from ..sources.lake import Lake, Table, Transaction


def _staged(lake: Lake, tx: Transaction, t: Table, df: DataFrame) -> DataFrame:
    """Written once and read again: what follows from it is computed from the same rows."""
    path = f"{t.path}/staged-{uuid.uuid4().hex}"
    tx.written.append(path)
    df.write.parquet(path)
    return lake.spark.read.schema(df.schema).parquet(path)


def _drop_stage(lake: Lake, df: DataFrame, tx: Transaction) -> None:
    for p in [p for p in tx.written if "/staged-" in p]:
        files.remove(lake.spark, p)
        tx.written.remove(p)


def mark_deleted(lake: Lake, tx: Transaction, t: Table, hits: DataFrame) -> int:
    """`hits`: _file_id, _pos of rows to go (staged). Whole files end; few places go into the catalog, more into a file."""
    cat, at = lake._c, lake.current_snapshot()
    counts = {r["_file_id"]: r["n"] for r in hits.groupBy("_file_id").agg(F.count("*").alias("n")).collect()}  # a row for each file
    if not counts:
        return 0
    own = {r["id"]: r for r in cat.rows(f"SELECT * FROM data_file WHERE table_id = :t AND {VISIBLE}", t=t.id, s=at)}
    before: dict[int, int] = {}
    for r in cat.rows("SELECT file_id, sum(rows) AS n FROM delete_of WHERE table_id = :t AND begin <= :s GROUP BY file_id", t=t.id, s=at):
        before[r["file_id"]] = r["n"]
    for r in cat.rows("SELECT file_id, count(*) AS n FROM inlined_delete WHERE table_id = :t AND begin <= :s GROUP BY file_id", t=t.id, s=at):
        before[r["file_id"]] = before.get(r["file_id"], 0) + r["n"]
    whole = [i for i, n in counts.items() if i >= 0 and n + before.get(i, 0) == own[i]["rows"]]
    part = {i: n for i, n in counts.items() if i >= 0 and i not in set(whole)}
    inline = [r["_pos"] for r in hits.filter("_file_id < 0").select("_pos").collect()] if -1 in counts else []  # rows of the catalog
    limit = int(lake.option("data_inlining_row_limit", t))
    few: list[tuple[int, int]] = []
    path = None
    if part and sum(part.values()) <= limit:
        few = [(r["_file_id"], r["_pos"]) for r in hits.filter(F.col("_file_id").isin(list(part))).collect()]  # no more than the limit
    elif part:
        path = f"{t.path}/deletes-{uuid.uuid4().hex}"
        tx.written.append(path)
        kept = hits.filter("_file_id >= 0")
        if whole:
            kept = kept.join(files.listed(lake.spark.createDataFrame([(i,) for i in whole], "_file_id long"), len(whole)), "_file_id", "left_anti")
        kept.select("_file_id", "_pos").sort("_file_id", "_pos").write.options(**write.options(lake, t)).parquet(path)
    delete_id = lake._cat.take("file")
    size = sum(b for _, b, _ in files.listing(lake.spark, path)) if path else 0

    def step(c: Catalog, s: int) -> None:
        for i in whole:
            if c.one("SELECT id FROM data_file WHERE id = :i AND stop IS NULL", i=i) is None:
                raise ConflictError(f'Transaction conflict - a file of table "{t.name}" with rows to delete is gone')
            c.run("UPDATE data_file SET stop = :s, origin = origin || '/deleted' WHERE id = :i", s=s, i=i)
        c.many("INSERT INTO inlined_delete VALUES (?, ?, ?, ?)", [(t.id, i, p, s) for i, p in few])
        if path:
            c.run("INSERT INTO delete_file VALUES (:i, :t, :s, :p, :n, :b)", i=delete_id, t=t.id, s=s, p=path, n=sum(part.values()), b=size)
            c.many("INSERT INTO delete_of VALUES (?, ?, ?, ?, ?)", [(delete_id, i, t.id, s, n) for i, n in part.items()])
        for p in inline:
            c.run("DELETE FROM inlined WHERE table_id = :t AND row_id = :r AND stop IS NULL AND begin = :s", t=t.id, r=p, s=s)
            c.run("UPDATE inlined SET stop = :s WHERE table_id = :t AND row_id = :r AND stop IS NULL", s=s, t=t.id, r=p)
        c.run("UPDATE table_stats SET rows = rows - :n WHERE table_id = :t", n=sum(counts.values()), t=t.id)

    # Rows of files go from their files, wherever their places are kept; rows of the catalog are another kind of change.
    touched = [i for i in counts if i >= 0]
    tx.add("deleted_from_table" if touched else "inlined_delete", t.id, step, detail=touched)
    if touched and inline:
        tx.changes.append(["inlined_delete", str(t.id), None])
    return sum(counts.values())


def delete(lake: Lake, name: str, where: str | Expression | None, alias: str | None = None) -> int:
    """Rows deleted. Without a condition, or where all of a file's rows go, the file ends as a whole."""
    with lake._change() as tx:
        t = lake._table(name)
        rows = scan.table(lake, t, lake.current_snapshot(), where, meta=True, alias=alias)
        hits = _staged(lake, tx, t, rows.select("_file_id", "_pos"))
        n = mark_deleted(lake, tx, t, hits)
        _drop_stage(lake, hits, tx)
    return n


def truncate(lake: Lake, name: str) -> int:
    """Ends all files and rows of a table in the catalog; none is read."""
    with lake._change() as tx:
        t, at = lake._table(name), lake.current_snapshot()
        n = lake.count(name)
        own = [r["id"] for r in lake._c.rows(f"SELECT id FROM data_file WHERE table_id = :t AND {VISIBLE}", t=t.id, s=at)]
        inline = lake._c.one(f"SELECT count(*) AS n FROM inlined WHERE table_id = :t AND {VISIBLE}", t=t.id, s=at)["n"]
        if not own and not inline:
            return 0

        def step(c: Catalog, s: int) -> None:
            for i in own:
                if c.one("SELECT id FROM data_file WHERE id = :i AND stop IS NULL", i=i) is None:
                    raise ConflictError(f'Transaction conflict - a file of table "{t.name}" with rows to delete is gone')
                c.run("UPDATE data_file SET stop = :s, origin = origin || '/deleted' WHERE id = :i", s=s, i=i)
            c.run("DELETE FROM inlined WHERE table_id = :t AND stop IS NULL AND begin = :s", t=t.id, s=s)
            c.run("UPDATE inlined SET stop = :s WHERE table_id = :t AND stop IS NULL", s=s, t=t.id)
            c.run("UPDATE table_stats SET rows = rows - :n WHERE table_id = :t", n=n, t=t.id)

        tx.add("deleted_from_table" if own else "inlined_delete", t.id, step, detail=own)
        if own and inline:
            tx.changes.append(["inlined_delete", str(t.id), None])
    return n


def _assigned(t: Table, assignments: dict[str, str | Expression], alias: str) -> list[Column]:
    new = {k.lower(): v for k, v in assignments.items()}
    if unknown := set(new) - {f["name"].lower() for f in t.fields}:
        raise CatalogError(f"no such columns: {sorted(unknown)}")
    if any(isinstance(v, str) and v.strip().upper() == "DEFAULT" for v in new.values()):
        raise NotSupported("SET … = DEFAULT is not supported")
    return [(column(new[f["name"].lower()]).cast(schema.field_type(f)) if f["name"].lower() in new else F.col(f"`{alias}`.`{f['name']}`")).alias(f["name"]) for f in t.fields]


def replace_rows(lake: Lake, tx: Transaction, t: Table, rows: DataFrame) -> None:
    """New versions of rows: the table's columns and _row_id."""
    write.add_rows(lake, tx, t, rows.withColumn("_snapshot_id", F.lit(None).cast("long")), int(lake.option("data_inlining_row_limit", t)), embeds=True, kind="update")


def update(lake: Lake, name: str, assignments: dict[str, str | Expression], where: str | Expression | None, source: DataFrame | None = None, alias: str = "target") -> int:
    """Expressions may name `target` (or what `alias` says) and, with a DataFrame to update from, `source`. Of several matches of a row the first counts."""
    with lake._change() as tx:
        t = lake._table(name)
        at = lake.current_snapshot()
        if source is None:
            rows = scan.table(lake, t, at, where, meta=True, alias=alias)
        else:
            if not where:
                raise LakeError("an update from another table needs a condition")
            rows = scan.table(lake, t, at, None, meta=True, alias=alias).join(source.alias("source"), column(where)).dropDuplicates(["_file_id", "_pos"])
        staged = _staged(lake, tx, t, rows.select(*_assigned(t, assignments, alias), *scan.META))
        n = mark_deleted(lake, tx, t, staged.select("_file_id", "_pos"))
        if n:
            replace_rows(lake, tx, t, staged.select(*[f"`{f['name']}`" for f in t.fields], "_row_id"))
        _drop_stage(lake, staged, tx)
    return n


class Merge:
    """MERGE INTO: clauses in the order given, then execute(). Expressions name `target` and `source`, or what `names` says."""

    def __init__(self, lake: Lake, name: str, source: DataFrame, on: str | list[str] | Expression):
        self.lake, self.name, self.source = lake, name, source
        self.on = " AND ".join(f"target.`{c}` = source.`{c}`" for c in on) if isinstance(on, list) else on
        self.names = ("target", "source")
        self.clauses: list[tuple[str, str, str | Expression | None, dict[str, str | Expression] | None]] = []

    def _add(self, when: str, action: str, condition: str | None, values: dict[str, str] | None = None) -> Merge:
        if action in ("update", "delete") and any(a in ("update", "delete") for _, a, _, _ in self.clauses):
            raise NotSupported("a merge has at most one UPDATE or DELETE action")
        self.clauses.append((when, action, condition, values))
        return self

    def when_matched_update(self, values: dict[str, str] | None = None, condition: str | None = None) -> Merge:
        return self._add("matched", "update", condition, values)

    def when_matched_delete(self, condition: str | None = None) -> Merge:
        return self._add("matched", "delete", condition)

    def when_matched_error(self, condition: str | None = None) -> Merge:
        return self._add("matched", "error", condition)

    def when_matched_do_nothing(self, condition: str | None = None) -> Merge:
        return self._add("matched", "nothing", condition)

    def when_not_matched_insert(self, values: dict[str, str] | None = None, condition: str | None = None) -> Merge:
        return self._add("new", "insert", condition, values)

    def when_not_matched_by_source_update(self, values: dict[str, str], condition: str | None = None) -> Merge:
        return self._add("alone", "update", condition, values)

    def when_not_matched_by_source_delete(self, condition: str | None = None) -> Merge:
        return self._add("alone", "delete", condition)

    def execute(self) -> dict[str, int]:
        """Numbers of rows updated, deleted and inserted."""
        lake = self.lake
        with lake._change() as tx:
            t = lake._table(self.name)
            target = scan.table(lake, t, lake.current_snapshot(), None, meta=True).withColumn("_there", F.lit(True)).alias(self.names[0])
            source = self.source.withColumn("_given", F.lit(True)).alias(self.names[1])
            kinds = {w for w, _, _, _ in self.clauses}
            how = "full" if {"new", "alone"} <= kinds else "right" if "new" in kinds else "left" if "alone" in kinds else "inner"
            rows = target.join(source, column(self.on), how)
            matched, new = F.col("_there").isNotNull() & F.col("_given").isNotNull(), F.col("_there").isNull()
            state = {"matched": matched, "new": new, "alone": F.col("_given").isNull()}
            which = F.lit(-1)
            for k, (when, _, condition, _) in reversed(list(enumerate(self.clauses))):
                hit = state[when] & F.coalesce(column(condition), F.lit(False)) if condition else state[when]
                which = F.when(hit, k).otherwise(which)
            rows = rows.withColumn("_clause", which).filter("_clause >= 0")
            cols = []
            everything = {f["name"]: f"`{self.names[1]}`.`{f['name']}`" for f in t.fields}
            for f in t.fields:
                kind, c = schema.field_type(f), F.lit(None).cast(schema.field_type(f))
                for k, (_, action, _, values) in enumerate(self.clauses):
                    if action == "update":
                        v = {a.lower(): b for a, b in (values or everything).items()}
                        new_value = column(v[f["name"].lower()]).cast(kind) if f["name"].lower() in v else F.col(f"`{self.names[0]}`.`{f['name']}`")
                    elif action == "insert":
                        v = {a.lower(): b for a, b in (values or everything).items()}
                        new_value = column(v[f["name"].lower()]).cast(kind) if f["name"].lower() in v else F.expr(f["default"]).cast(kind) if f["default"] else F.lit(None).cast(kind)
                    else:
                        continue
                    c = F.when(F.col("_clause") == k, new_value).otherwise(c)
                cols.append(c.alias(f["name"]))
            staged = _staged(lake, tx, t, rows.select(*cols, *scan.META, "_clause"))
            of = lambda *actions: [k for k, (_, a, _, _) in enumerate(self.clauses) if a in actions]
            if of("error") and staged.filter(F.col("_clause").isin(of("error"))).limit(1).count():
                raise LakeError("a row satisfies WHEN MATCHED THEN ERROR")
            names = [f"`{f['name']}`" for f in t.fields]
            changed = staged.filter(F.col("_clause").isin(of("update", "delete"))).dropDuplicates(["_file_id", "_pos"])
            changed = _staged(lake, tx, t, changed) if of("update", "delete") else None
            out = {"updated": 0, "deleted": 0, "inserted": 0}
            if changed is not None:
                n = mark_deleted(lake, tx, t, changed.select("_file_id", "_pos"))
                if of("update"):
                    out["updated"] = n
                    if n:
                        replace_rows(lake, tx, t, changed.select(*names, "_row_id"))
                else:
                    out["deleted"] = n
            if of("insert"):
                fresh = staged.filter(F.col("_clause").isin(of("insert"))).select(*names)
                before = len(tx.steps)
                write.add_rows(lake, tx, t, fresh, int(lake.option("data_inlining_row_limit", t)))
                out["inserted"] = fresh.count() if len(tx.steps) > before else 0
            _drop_stage(lake, staged, tx)
        return out


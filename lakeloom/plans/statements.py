"""SQL statements that change a lake: INSERT, UPDATE, DELETE, MERGE, TRUNCATE, CREATE, ALTER, DROP, COMMENT, CALL, and transactions.

Spark's parser makes their trees; what it has no words for (BEGIN, macros, sort keys and the like) is matched as a whole.
A statement gives a DataFrame: of column `count` with the rows that it changed, or what a called procedure gives, or no rows.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput, NotSupported
from ..sources import schema
from . import parsed, prune
from .parsed import Expression, items, names

if TYPE_CHECKING:
    from ..sources.lake import Lake

# Transforms that Spark names in the plural, which count from 1970.
_PLURAL = {"years": "epoch_year", "months": "epoch_month", "days": "epoch_day", "hours": "epoch_hour"}
_PROCEDURES = {
    "snapshots", "table_info", "list_files", "options", "settings_info", "merge_adjacent_files", "rewrite_data_files", "flush_inlined_data", "expire_snapshots", "cleanup_old_files", "delete_orphaned_files", "checkpoint",
    "set_option", "set_commit_message", "add_files", "current_snapshot", "last_committed_snapshot",
}
_NAME = r"([\w.`]+)"
Handler = Callable[["Lake", Any], DataFrame]


def execute(lake: Lake, text: str, args: Any = None) -> DataFrame | None:
    """The statement's result; None if it is a query."""
    text = text.strip().rstrip(";")
    if not re.match(r"(?:--[^\n]*\n|/\*.*?\*/|\s)*(?:with|insert|update|delete|merge|truncate|create|replace|alter|drop|comment|call|begin|start|commit|rollback|show|describe|desc|abort)\b", text, re.I | re.S):
        return None
    for pattern, run in _WHOLE:
        if m := re.fullmatch(pattern, text, re.I | re.S):
            return _done(lake, run(lake, *m.groups()))
    tree = parsed.plan(lake.spark, text)
    inner = tree.child() if parsed.kind(tree) == "UnresolvedWith" else tree
    run = _HANDLERS.get(parsed.kind(inner))
    if run is None:
        if _command(lake, inner):
            raise NotSupported(f"{parsed.kind(inner)} is not a statement of a lake")
        return None
    if args:
        raise NotSupported("only queries have parameters")
    if run in _READING:
        tree = parsed.plan(lake.spark, lake._bound(text, lake.current_snapshot()))
    return run(lake, tree)


def _command(lake: Lake, tree: Any) -> bool:
    return lake.spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command").isInstance(tree)


def _done(lake: Lake, result: Any = None) -> DataFrame:
    if isinstance(result, DataFrame):
        return result
    return lake.spark.createDataFrame([(int(result),)] if result is not None else [], "count long")


@contextlib.contextmanager
def _together(lake: Lake):
    """One transaction, the open one if there is one."""
    if lake._tx is not None:
        yield
        return
    with lake.transaction() as tx:
        tx.author, tx.message, tx.extra = getattr(lake, "_message", (None, None, None))
        yield


def _plain(name: str) -> str:
    return name.replace("`", "")


def _target(node: Any) -> tuple[str, str]:
    """A table's name in the lake, and what the statement calls it."""
    alias = None
    if parsed.kind(node) == "SubqueryAlias":
        alias, node = node.alias(), node.child()
    own = names(node.multipartIdentifier())
    return ".".join(own), alias or own[-1]


def _identifier(node: Any) -> str:
    return ".".join(names(node.nameParts() if parsed.kind(node) == "UnresolvedIdentifier" else node.multipartIdentifier()))


def _type(t: Any) -> T.DataType:
    return T._parse_datatype_json_string(t.json())


def _option(o: Any) -> Any:
    return o.get() if o.isDefined() else None


def _assignments(lake: Lake, seq: Any, alias: str) -> dict[str, Expression]:
    out: dict[str, Expression] = {}
    for a in items(seq):
        path = names(a.key().nameParts())
        path = path[1:] if len(path) > 1 and path[0].lower() == alias.lower() else path
        if len(path) > 1:
            raise NotSupported(f"{'.'.join(path)}: whole columns are assigned, not their fields")
        if path[0].lower() in {k.lower() for k in out}:
            raise InvalidInput(f"{path[0]} is assigned twice")
        if _is_default(a.value()):
            raise NotSupported("SET … = DEFAULT is not supported")
        out[path[0]] = Expression(lake.spark, a.value())
    return out


def _is_default(e: Any) -> bool:
    return parsed.kind(e) == "UnresolvedAttribute" and [n.upper() for n in names(e.nameParts())] == ["DEFAULT"]


# Rows


def _values(lake: Lake, name: str, columns: list[str], rows: list[list]) -> DataFrame:
    """Rows of VALUES, of which some are DEFAULT."""
    own = {f["name"].lower(): f for f in lake._table(name).fields}
    if unknown := {c.lower() for c in columns} - set(own):
        raise InvalidInput(f"no such columns: {sorted(unknown)}")
    out: DataFrame | None = None
    for row in rows:
        if len(row) != len(columns):
            raise InvalidInput(f"{len(columns)} columns, but a row of {len(row)} values")
        cells = []
        for c, e in zip(columns, row, strict=True):
            f = own[c.lower()]
            value = F.expr(f["default"] or "NULL") if _is_default(e) else Expression(lake.spark, e).column
            cells.append(value.cast(schema.field_type(f)).alias(c))
        one = lake.spark.range(1).select(*cells)
        out = one if out is None else out.unionAll(one)
    return out


def _insert(lake: Lake, tree: Any) -> DataFrame:
    into = tree.child() if parsed.kind(tree) == "UnresolvedWith" else tree
    if into.partitionSpec().size() or into.ifPartitionNotExists():
        raise NotSupported("partitions follow from the rows")
    query = tree.copy(into.query(), tree.cteRelations(), tree.allowRecursion()) if into is not tree else into.query()
    name, columns = _target(into.table())[0], names(into.userSpecifiedCols()) or None
    rows = [items(r) for r in items(query.rows())] if parsed.kind(query) == "UnresolvedInlineTable" else []
    if any(_is_default(e) for r in rows for e in r):
        df = _values(lake, name, columns or [f["name"] for f in lake._table(name).fields], rows)
    else:
        df = parsed.frame(lake.spark, query)
        columns = columns or (df.columns if into.byName() else None)
    if not into.overwrite():
        return _done(lake, lake.insert(name, df, columns))
    with _together(lake):
        lake.truncate(name)
        lake.insert(name, df, columns)
    return _done(lake)


def _delete(lake: Lake, tree: Any) -> DataFrame:
    name, alias = _target(tree.table())
    condition = tree.condition()
    everything = parsed.kind(condition) == "Literal" and condition.toString() == "true"
    return _done(lake, lake.truncate(name) if everything else lake.delete(name, Expression(lake.spark, condition), alias=alias))


def _update(lake: Lake, tree: Any) -> DataFrame:
    name, alias = _target(tree.table())
    where = _option(tree.condition())
    return _done(lake, lake.update(name, _assignments(lake, tree.assignments(), alias), where and Expression(lake.spark, where), alias=alias))


def _merge(lake: Lake, tree: Any) -> DataFrame:
    name, alias = _target(tree.targetTable())
    source = tree.sourceTable()
    given = source.alias() if parsed.kind(source) == "SubqueryAlias" else "source"
    m = lake.merge(name, parsed.frame(lake.spark, source), Expression(lake.spark, tree.mergeCondition()))
    m.names = (alias, given)
    for when, actions in (("matched", tree.matchedActions()), ("new", tree.notMatchedActions()), ("alone", tree.notMatchedBySourceActions())):
        for a in items(actions):
            what = parsed.kind(a)
            condition = _option(a.condition())
            values = _assignments(lake, a.assignments(), alias) if what in ("UpdateAction", "InsertAction") else None
            m._add(when, {"Upd": "update", "Ins": "insert", "Del": "delete"}[what[:3]], condition and Expression(lake.spark, condition), values)
    return _done(lake, sum(m.execute().values()))


# Tables and views


def _keys(seq: Any) -> list[str]:
    out = []
    for t in items(seq):
        args = [a.toString() for a in t.arguments()]
        kind = _PLURAL.get(t.name(), t.name())
        out.append(args[0] if kind == "identity" else f"{kind}({', '.join(args)})")
    return out


def _create(lake: Lake, tree: Any) -> DataFrame:
    name, again = _identifier(tree.name()), parsed.kind(tree).startswith("Replace")
    spec = tree.tableSpec()
    if _option(spec.location()) or _option(spec.provider()) not in (None, "parquet"):
        raise NotSupported("the lake chooses where and how a table is kept")
    if again and not tree.orCreate():
        lake._table(name)
    how: dict[str, Any] = {"or_replace": again, "if_not_exists": not again and tree.ignoreIfExists(), "partitioned_by": _keys(tree.partitioning()) or None}
    there = not again and lake._find("tbl", name, lake.current_snapshot()) is not None
    with _together(lake):
        if parsed.kind(tree).endswith("AsSelect"):
            if there and how["if_not_exists"]:
                return _done(lake)
            lake.create_table_as(name, parsed.frame(lake.spark, tree.query()), **how)
        else:
            columns = items(tree.columns())
            lake.create_table(name, T.StructType([T.StructField(c.name(), _type(c.dataType()), c.nullable()) for c in columns]), **how)
            if there:
                return _done(lake)
            for c in columns:
                if (d := _option(c.defaultValue())) is not None:
                    lake.set_default(name, c.name(), d.originalSQL())
                if (text := _option(c.comment())) is not None:
                    lake.comment(name, text, column=c.name())
        if (text := _option(spec.comment())) is not None:
            lake.comment(name, text)
    return _done(lake)


def _view(lake: Lake, tree: Any) -> DataFrame:
    name = _identifier(tree.child())
    if tree.allowExisting() and lake._find("view", name, lake.current_snapshot()) is not None:
        return _done(lake)
    columns = [c._1() for c in items(tree.userSpecifiedColumns())]
    lake.create_view(name, tree.originalText().get(), columns or None, or_replace=tree.replace())
    return _done(lake)


def _add_columns(lake: Lake, tree: Any) -> DataFrame:
    name = _identifier(tree.table())
    with _together(lake):
        for c in items(tree.columnsToAdd()):
            path = [*names(c.path().get().name()), c.colName()] if c.path().isDefined() else [c.colName()]
            default, value = _option(c.default()), None
            if default is not None:
                known, value = prune._value(default.child())
                if not known:
                    raise NotSupported("a new column's default is a literal")
            lake.add_column(name, ".".join(path), _type(c.dataType()), value)
            if not c.nullable():
                lake.set_not_null(name, ".".join(path))
            if (text := _option(c.comment())) is not None:
                lake.comment(name, text, column=".".join(path))
    return _done(lake)


def _alter_columns(lake: Lake, tree: Any) -> DataFrame:
    name = _identifier(tree.table())
    with _together(lake):
        for c in items(tree.specs()):
            col = ".".join(names(c.column().name()))
            if (t := _option(c.newDataType())) is not None:
                lake.set_type(name, col, _type(t))
            if (n := _option(c.newNullability())) is not None:
                (lake.drop_not_null if n else lake.set_not_null)(name, col)
            if (text := _option(c.newComment())) is not None:
                lake.comment(name, text, column=col)
            if (d := _option(c.newDefaultExpression())) is not None:
                lake.set_default(name, col, d.originalSQL())
            if c.dropDefault():
                lake.set_default(name, col, None)
            if _option(c.newPosition()) is not None:
                raise NotSupported("columns keep their places")
    return _done(lake)


def _call(lake: Lake, tree: Any) -> DataFrame:
    name = names(tree.procedure().nameParts())[-1].lower()
    if name not in _PROCEDURES:
        raise InvalidInput(f"unknown procedure {name}")

    def value(e: Any) -> Any:
        if parsed.kind(e) == "UnresolvedFunction" and names(e.nameParts()) == ["array"]:
            return [value(x) for x in items(e.children())]
        known, v = prune._value(e)
        if not known:
            raise InvalidInput(f"{e.toString()}: procedures take literals")
        return v

    plain, named = [], {}
    for e in items(tree.args()):
        if parsed.kind(e) == "NamedArgumentExpression":
            named[e.key()] = value(e.value())
        else:
            plain.append(value(e))
    return _done(lake, getattr(lake, name)(*plain, **named))


def _show(lake: Lake, tree: Any) -> DataFrame:
    return lake.spark.createDataFrame([tuple(n.rsplit(".", 1)) for n in sorted(lake._names(lake.current_snapshot()))], "schema_name string, table_name string")


def _describe(lake: Lake, tree: Any) -> DataFrame:
    name = _identifier(tree.relation())
    text = lake.comments(name)
    return lake.spark.createDataFrame([(f.name, f.dataType.simpleString(), text.get(f.name.lower())) for f in lake.table(name).schema.fields], "col_name string, data_type string, comment string")


def _then(f: Callable[[Lake, Any], Any]) -> Handler:
    return lambda lake, tree: _done(lake, f(lake, tree))


_HANDLERS: dict[str, Handler] = {
    "InsertIntoStatement": _insert, "DeleteFromTable": _delete, "UpdateTable": _update, "MergeIntoTable": _merge, "CreateTable": _create, "CreateTableAsSelect": _create, "ReplaceTable": _create, "ReplaceTableAsSelect": _create,
    "CreateView": _view, "AddColumns": _add_columns, "AlterColumns": _alter_columns, "Call": _call, "ShowTables": _show, "DescribeRelation": _describe,
    "TruncateTable": _then(lambda lake, x: lake.truncate(_identifier(x.table()))),
    "DropTable": _then(lambda lake, x: lake.drop_table(_identifier(x.child()), if_exists=x.ifExists())),
    "DropView": _then(lambda lake, x: lake.drop_view(_identifier(x.child()), if_exists=x.ifExists())),
    "CreateNamespace": _then(lambda lake, x: lake.create_schema(_identifier(x.name()), if_not_exists=x.ifNotExists())),
    "DropNamespace": _then(lambda lake, x: lake.drop_schema(_identifier(x.namespace()), cascade=x.cascade(), if_exists=x.ifExists())),
    "RenameTable": _then(lambda lake, x: (lake.rename_view if x.isView() else lake.rename_table)(_identifier(x.child()), names(x.newName())[-1])),
    "RenameColumn": _then(lambda lake, x: lake.rename_column(_identifier(x.table()), ".".join(names(x.column().name())), x.newName())),
    "DropColumns": _then(lambda lake, x: [lake.drop_column(_identifier(x.table()), ".".join(names(c.name())), if_exists=x.ifExists()) for c in items(x.columnsToDrop())] and None),
    "CommentOnTable": _then(lambda lake, x: lake.comment(_identifier(x.table()), x.comment() or None)),
    "CreateIndex": lambda lake, x: lake.create_index(),
}
_READING = {_insert, _delete, _update, _merge, _create}


def _split(keys: str) -> list[str]:
    from ..sources.lake import _commas

    return [k.strip() for k in _commas(keys)]


def _literal(text: str) -> str | None:
    return None if text.upper() == "NULL" else text[1:-1].replace("''", "'")


def _macro(lake: Lake, again: str | None, name: str, params: str, table: str | None, body: str) -> None:
    lake.create_macro(_plain(name), params, **{"table" if table else "expression": body.strip()}, or_replace=bool(again))


# What Spark's parser doesn't know, as a whole: pattern and what to do with its groups.
_WHOLE: list[tuple[str, Callable[..., Any]]] = [
    (r"(?:BEGIN|START)(?:\s+TRANSACTION)?", lambda lake: lake.begin() and None),
    (r"COMMIT", lambda lake: lake.commit() and None),
    (r"(?:ROLLBACK|ABORT)", lambda lake: lake.rollback()),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+SET\s+PARTITIONED\s+BY\s*\((.*)\)", lambda lake, t, keys: lake.set_partitioned_by(_plain(t), *_split(keys))),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+RESET\s+PARTITIONED\s+BY", lambda lake, t: lake.set_partitioned_by(_plain(t))),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+SET\s+SORTED\s+BY\s*\((.*)\)", lambda lake, t, keys: lake.set_sorted_by(_plain(t), *_split(keys))),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+RESET\s+SORTED\s+BY", lambda lake, t: lake.set_sorted_by(_plain(t))),
    (rf"COMMENT\s+ON\s+(?:TABLE|VIEW)\s+{_NAME}\s+IS\s+(NULL|'(?:[^']|'')*')", lambda lake, t, text: lake.comment(_plain(t), _literal(text))),
    (rf"COMMENT\s+ON\s+COLUMN\s+{_NAME}\.([\w`]+)\s+IS\s+(NULL|'(?:[^']|'')*')", lambda lake, t, c, text: lake.comment(_plain(t), _literal(text), column=_plain(c))),
    (rf"CREATE\s+(OR\s+REPLACE\s+)?MACRO\s+{_NAME}\s*\(([^)]*(?:\([^)]*\)[^)]*)*)\)\s*AS\s+(TABLE\s+)?(.+)", _macro),
    (rf"DROP\s+MACRO\s+(?:TABLE\s+)?{_NAME}", lambda lake, m: lake.drop_macro(_plain(m))),
    (r"CREATE\s+(?:OR\s+REPLACE\s+)?SEQUENCE\b.*", lambda lake: lake.create_sequence()),
    (r"CREATE\s+TYPE\b.*", lambda lake: lake.create_type()),
    (r"CREATE\s+(?:UNIQUE\s+)?INDEX\b.*", lambda lake: lake.create_index()),
]

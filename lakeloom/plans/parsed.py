"""What Spark's parser says of SQL text: the tables that it names, with their places in the text, and expressions as trees."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statements whose first child is the table that they change.
_TARGETS = {"DeleteFromTable", "UpdateTable", "MergeIntoTable"}
_LIMITS = {"GlobalLimit", "LocalLimit", "Offset"}


class Expression:
    """An expression of a statement. It may hold subqueries, which SQL text made from a tree can't."""

    def __init__(self, spark: SparkSession, tree: Any):
        self.tree = tree
        self.column = Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(tree))


def column(e: str | Expression) -> Column:
    return F.expr(e) if isinstance(e, str) else e.column


def plan(spark: SparkSession, text: str) -> Any:
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def raw(spark: SparkSession, tree: Any) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, tree), spark)


def frame(spark: SparkSession, tree: Any) -> DataFrame:
    return ordered(raw(spark, tree))


def ordered(df: DataFrame) -> DataFrame:
    """The frame with ORDER BY … LIMIT of its subqueries as written.

    Where a subquery is correlated, Spark takes the order of its limit from a sort straight below. For columns that only
    ORDER BY names it puts a projection between, and then any rows come. Here the projection goes above the limit.
    """
    jvm, tree = df.sparkSession._jvm, df._jdf.queryExecution().analyzed()
    found = jvm.java.util.HashMap()

    def over(node: Any, child: Any) -> Any:
        return node.withNewChildren(jvm.PythonUtils.toSeq([child]))

    def look(node: Any, within: bool) -> None:
        if within and kind(node) in _LIMITS:
            limits, projects, at = [], [], node
            while kind(at) in _LIMITS:
                limits.append(at)
                at = at.child()
            while kind(at) == "Project":
                projects.append(at)
                at = at.child()
            if projects and kind(at) == "Sort":
                for x in reversed([*projects, *limits]):
                    at = over(x, at)
                found.put(node, at)
        for child in items(node.children()):
            look(child, within)
        for query in items(node.subqueries()):
            look(query, True)

    look(tree, False)
    return df if found.isEmpty() else raw(df.sparkSession, tree.transformDownWithSubqueries(jvm.PythonUtils.toScalaMap(found)))


def kind(node: Any) -> str:
    return node.getClass().getSimpleName()


def items(seq: Any) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def names(seq: Any) -> list[str]:
    return [str(x) for x in items(seq)]


def place(node: Any) -> tuple[int, int]:
    o = node.origin()
    return o.startIndex().get(), o.stopIndex().get() + 1


class Reference:
    """A table named in the text, at start to end with its time travel; `parent` is the kind of node above it."""

    def __init__(self, parts: list[str], start: int, name_end: int, end: int, parent: str):
        self.parts, self.start, self.name_end, self.end, self.parent = parts, start, name_end, end, parent


def references(node: Any, given: frozenset[str] = frozenset(), parent: str = "") -> Iterator[Reference]:
    """Tables that a statement reads; not the one that it changes, and not those that a WITH gives where it holds."""
    what = kind(node)
    if what == "UnresolvedRelation":
        parts = names(node.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in given:
            start, end = place(node)
            yield Reference(parts, start, end, end, parent)
        return
    if what == "RelationTimeTravel":
        for r in references(node.relation(), frozenset(), parent):
            r.end = place(node)[1]
            yield r
        return
    if what == "UnresolvedWith":
        for x in items(node.cteRelations()):
            own = x._1().lower()
            yield from references(x._2(), given | {own} if node.allowRecursion() else given)
            given = given | {own}
    if what == "ExplainCommand":
        yield from references(node.logicalPlan(), given)
    for k, child in enumerate(items(node.children())):
        if k or what not in _TARGETS:
            yield from references(child, given, what)
    for query in items(node.subqueries()):
        yield from references(query, given, what)

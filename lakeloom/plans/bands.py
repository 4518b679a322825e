"""Joins on a band, `y BETWEEN x - a AND x + b` without an equality, which Spark would carry out by comparing all pairs.

The line is cut into cells as wide as the band. Each row of x goes to the few cells that its band touches, each row of y
to its own, and the cells are joined by equality; the condition as written decides. Rows of y in a cell that has many are
dealt out in pieces, to each of which the cell's rows of x go.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsed

#: Rows of y of a piece. Cells beyond it are at most a part of 1 / PIECE of the rows, so their list is broadcast.
PIECE = 1 << 16
_LESS = {"LessThan", "LessThanOrEqual"}
_MORE = {"GreaterThan", "GreaterThanOrEqual"}


def _conjuncts(e: Any) -> list[Any]:
    if parsed.kind(e) == "And":
        return _conjuncts(e.left()) + _conjuncts(e.right())
    return [e]


def _ordered(e: Any) -> list[tuple[Any, Any]]:
    """Pairs of expressions of which the first is not the greater where e holds."""
    what = parsed.kind(e)
    if what == "Between":
        return [(e.lower(), e.input()), (e.input(), e.upper())]
    return [(e.left(), e.right())] if what in _LESS else [(e.right(), e.left())] if what in _MORE else []


def _shifted(e: Any) -> tuple[Any, float]:
    """(x, c) of an expression x + c."""
    while parsed.kind(e) == "Cast" and _numeric(e.child()):
        e = e.child()
    what = parsed.kind(e)
    if what in ("Add", "Subtract"):
        for x, c in ((e.left(), e.right()), (e.right(), e.left()))[: 2 if what == "Add" else 1]:
            if c.foldable() and (v := c.eval(None)) is not None and _numeric(c):
                return x, float(str(v)) * (1 if what == "Add" else -1)
    return e, 0.0


def _numeric(e: Any) -> bool:
    return e.dataType().typeName().split("(")[0] in ("byte", "tinyint", "short", "smallint", "integer", "int", "long", "bigint", "float", "double", "decimal")


def _has(node: Any, what: str) -> bool:
    return parsed.kind(node) == what or any(_has(x, what) for x in parsed.items(node.children()))


def _band(node: Any) -> tuple[Any, Any, Any, float, bool] | None:
    """(lo, hi, y, hi - lo, whether y is of the right side) of an inner join whose condition has lo <= y <= hi and no equality."""
    if parsed.kind(node) != "Join" or node.joinType().toString() != "Inner" or node.condition().isEmpty():
        return None
    sides = [node.left().outputSet(), node.right().outputSet()]
    of = lambda e: next((k for k in (0, 1) if not e.references().isEmpty() and e.references().subsetOf(sides[k])), None)
    pairs = []
    for e in _conjuncts(node.condition().get()):
        what = parsed.kind(e)
        if what in ("EqualTo", "EqualNullSafe") and None not in (of(e.left()), of(e.right())) and of(e.left()) != of(e.right()):
            return None
        pairs += [(low, high) for low, high in _ordered(e) if _numeric(low) and _numeric(high)]
    for lo, y in pairs:
        for same, hi in pairs:
            if of(y) is None or of(lo) != 1 - of(y) or not y.semanticEquals(same) or of(hi) != of(lo):
                continue
            (x, a), (z, b) = _shifted(lo), _shifted(hi)
            if x.semanticEquals(z) and 0 < b - a < math.inf:
                return lo, hi, y, b - a, of(y) == 1
    return None


def _joined(df: DataFrame, node: Any, lo: Any, hi: Any, y: Any, width: float, right: bool) -> DataFrame:
    spark = df.sparkSession
    col = lambda e: Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))
    of_x, of_y = (parsed.raw(spark, t) for t in ((node.left(), node.right()) if right else (node.right(), node.left())))

    def cell(e: Any) -> Column:
        # Monotone, so a value between two others has a cell between theirs; NaN is the greatest.
        v = col(e).cast("double")
        return F.when(F.isnan(v), F.lit((1 << 63) - 1)).otherwise(F.floor(v / width))

    of_y = of_y.select("*", cell(y).alias("_y_cell"), F.monotonically_increasing_id().alias("_y_row")).filter("_y_cell IS NOT NULL")
    full = of_y.groupBy("_y_cell").count().filter(F.col("count") > PIECE).select(F.col("_y_cell").alias("_cell"), F.ceil(F.col("count") / PIECE).alias("_pieces"))
    n = F.coalesce("_pieces", F.lit(1).cast("long"))
    of_y = of_y.join(F.broadcast(full), F.col("_y_cell") == F.col("_cell"), "left").withColumn("_y_piece", F.pmod("_y_row", n)).drop("_cell", "_pieces")
    of_x = of_x.select("*", cell(lo).alias("_from"), cell(hi).alias("_to")).filter("_from <= _to").select("*", F.explode(F.sequence("_from", "_to")).alias("_x_cell"))
    of_x = of_x.join(F.broadcast(full), F.col("_x_cell") == F.col("_cell"), "left").withColumn("_x_piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    met = (F.col("_x_cell") == F.col("_y_cell")) & (F.col("_x_piece") == F.col("_y_piece")) & col(node.condition().get())
    # y first: Spark gives new ids to what it meets again, and the list of full cells is made of y.
    return of_y.join(of_x.drop("_cell", "_pieces"), met).select(*map(col, parsed.items(node.output())))


def spread(df: DataFrame) -> DataFrame:
    """The frame with its joins on bands carried out by cells."""
    jvm, tree = df.sparkSession._jvm, df._jdf.queryExecution().analyzed()
    found = jvm.java.util.HashMap()

    def look(node: Any) -> None:
        for child in parsed.items(node.children()):
            look(child)
        if (band := _band(node)) and node.deterministic() and not _has(node, "CTERelationRef") and not node.isStreaming():
            found.put(node, _joined(df, node, *band)._jdf.queryExecution().analyzed())

    look(tree)
    return df if found.isEmpty() else parsed.raw(df.sparkSession, tree.transformDown(jvm.PythonUtils.toScalaMap(found)))

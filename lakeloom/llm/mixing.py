"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations alone.

A source's share of the budget follows its weight, up to `max_epochs` times its size; what is above goes to the
others by weight until none is above. A source whose target is e times its size is taken whole floor(e) times, and
once more in part: documents in the order of a keyed hash until the words of the part are used up. The one document
at which they end is taken in part (`taken`) or whole if that brings the source nearer to its target (`repeats`).

Nulls: a null text has no words; null is a source of its own and comes last. A document without words is never
taken. Equal rows count one by one. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, columns, small, unused, written

#: Bits of the hash that one pass over the sizes settles; 60 bits in all.
_BITS = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def keyed_order(doc_id: Column, seed: int) -> Column:
    """60 bits that any engine can make: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) -> the same and `target`. One row for each source.

    Sources ordered by cap / weight are clamped from the first on: with those before it clamped, the first whose
    cap is not below its share of what is left fixes the level of all others. The level rises up to there and falls
    behind it, so it is the highest.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    df = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(max_epochs))
    df = df.withColumn("_budget", F.sum("source_size").over(everything) * float(share))
    df = df.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    df = df.withColumn("_level", F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(everything))
    return df.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _plan(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, and for each source its target and where its partial repetition ends."""
    slim = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), keyed_order(F.col("doc_id"), seed).alias("_h")), "mix")
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("_whole") * F.col("source_size"))).cast("long"))
    plan = written(plan.withColumns({"_cut": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")}), "mix-plan")
    # _cut: the leading bits of the hash at which the source's part ends; _before: the words in front of them.
    for used in range(0, 60, _BITS):
        inside = slim.filter("size > 0").join(small(plan).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        inside = inside.filter((F.shiftright("_h", 60 - used) == F.col("_cut")) if used else F.lit(True))
        cells = inside.groupBy("_s", F.shiftright("_h", 60 - used - _BITS).alias("_cell")).agg(F.sum("size").alias("_n"), F.first("_before").alias("_b"), F.first("_rest").alias("_r"))
        run = F.col("_b") + F.sum("_n").over(Window.partitionBy("_s").orderBy("_cell"))
        at = cells.withColumn("_run", run).filter("_run > _r").groupBy("_s").agg(F.min(F.struct("_cell", (F.col("_run") - F.col("_n")).alias("b"))).alias("_at"))
        # A part that ends with the source has no cell beyond it: the cut is then past the last.
        plan = plan.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "_whole", "_rest", F.coalesce(F.col("_at._cell"), F.lit(1 << (used + _BITS))).alias("_cut"), F.coalesce(F.col("_at.b"), F.col("_before")).alias("_before")
        )
        plan = written(plan, "mix-plan")
    return slim, plan


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), repeats (whole documents); a row for each document."""
    slim, plan = _plan(docs, weights, share, max_epochs, seed)
    rows = slim.join(small(plan).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    # Documents that share the last hash are taken one after another.
    edge = F.col("_h") == F.col("_cut")
    last = rows.filter(edge).withColumn("_run", F.sum("size").over(Window.partitionBy("source", "_h").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.coalesce(F.col("_run"), F.lit(0)))).cast("long")
    rest = rows.filter(~edge).withColumn("_part", F.when(F.col("_h") < F.col("_cut"), F.col("size")).otherwise(0).cast("long"))
    both = rest.unionByName(last.withColumn("_part", part).drop("_run"))
    return both.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + F.col("_part")).alias("taken"),
        (F.when(F.col("size") == 0, 0).otherwise(F.col("_whole") + F.when(F.col("_part") * 2 >= F.col("size"), 1).otherwise(0))).cast("int").alias("repeats"),
    )


def repeated(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each whole document as often as `mix` repeats it, in the columns of `docs`, without a shuffle of texts.

    Rows that share a doc_id and a source are decided alike.
    """
    _, plan = _plan(docs, weights, share, max_epochs, seed)
    p = unused(docs, "plan")
    plan = plan.select(F.struct("*").alias(p))
    own = lambda c: F.col(f"{p}.{c}")
    h, size = keyed_order(F.col("doc_id"), seed), words(F.col("text"))
    extra = (h < own("_cut")) | ((h == own("_cut")) & ((own("_rest") - own("_before")) * 2 >= size))
    times = F.when(size == 0, 0).otherwise(own("_whole") + extra.cast("int")).cast("int")
    out = docs.join(small(plan), F.col("source").eqNullSafe(own("source")))
    return out.select(*columns(docs), F.explode(F.array_repeat(F.lit(0), times)).alias(p)).select(*columns(docs))

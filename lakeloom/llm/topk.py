"""Exact top-k by inner product, by distributed histogram selection.

Vectors become integers, floor(scale * x). Queries are taken in sets, bounded by their numbers and by their histograms,
which are broadcast one after another; every candidate is scored against each. A first pass counts all scores in coarse cells
for each query; the cell with the kth highest is looked into again, in finer cells, until a cell is one score. Then
what scores above the kth is kept, and of those at it the smallest identifiers. Counts are added up in each task
before they are dealt out; of rows at or above the kth score a task passes on no more than k a query, so ties and copies don't multiply.

Vectors that are null, empty or hold null or non-finite components take no part, nor do those whose length differs
from the query's. Equal rows are candidates one by one. An empty table gives no rows. Vectors with components of
LARGE or more are scored in whole numbers of any size, by themselves and against all others; each task passes on its k best, and ranks
are by the exact scores. A score that doesn't fit 64 bits is shown as the nearest that does.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, written

#: Numbers of a broadcast set of queries, cells of a pass for each query, and cells of a set.
BLOCK, CELLS, HISTOGRAMS = 1 << 22, 1 << 10, 1 << 22
#: Components up to which scores are made in 64 bits, whatever the length (of up to 2^12).
LARGE = 1 << 25
_ROWS, _QUERIES = 1 << 12, 256
_BEST = "query_id long, row long, rank_key string, vec_id long, score long"


def integers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v, the vector as integers; without the vectors that take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    sound &= ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale))
    large = F.exists(x, lambda e: F.abs(e * scale) >= LARGE)
    return vectors.filter(sound).select("vec_id", F.when(~large, v).alias("v"), F.when(large, x).alias("x"), F.monotonically_increasing_id().alias("row"))


def _scores(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: in floating point where that is exact."""
    return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if exact else q @ c.T


def top_k(vectors: DataFrame, query: Column | None = None, k: int = 20, scale: float = 64.0, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score. `query`: which rows are queries; each is asked against all rows but those of its own vec_id."""
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    query = F.col("vec_id") % 20 == 0 if query is None else query
    every = written(integers(vectors, scale), "vectors")
    huge = every.filter("x IS NOT NULL")
    table = every.filter("x IS NULL").select("vec_id", "v", "row")
    asked = table.filter(query).withColumn("n", F.size("v"))
    most = table.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0
    answers = []
    for n, count in sorted((r["n"], r["count"]) for r in asked.groupBy("n").count().collect()):  # a row for each length of vectors
        top = int(most) ** 2 * n
        if top >= 2**62:
            raise ValueError(f"vectors of {n} components")
        sets = max(-(-count * n // block), -(-count * cells // HISTOGRAMS))
        for part in range(sets):
            rows = asked.filter((F.col("n") == n) & (F.pmod(F.xxhash64("row"), F.lit(sets)) == part)).orderBy("vec_id").collect()  # about `block` numbers
            if not rows:
                continue
            ids = tuple(np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "row"))
            own = sc.broadcast((*ids, np.array([r["v"] for r in rows], np.int64)))
            with scratch(spark):
                answers.append(written(_answer(table.filter(F.size("v") == n), own, len(rows), k, cells, top), "answers", keep=True))
            own.destroy()
    out = spark.createDataFrame([], "query_id long, row long, rank int, vec_id long, score long")
    for x in answers:
        out = out.unionByName(x)
    if huge.limit(1).count():
        out = _with_huge(out, every, huge, query, k, scale)
    return out.select("query_id", "rank", "vec_id", "score")


def _sortable(score: int) -> str:
    """A string that sorts as the numbers do, whatever their size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _with_huge(out: DataFrame, every: DataFrame, huge: DataFrame, query: Column, k: int, scale: float) -> DataFrame:
    """The answers with what vectors of large components add, as queries or candidates: blocks of them against all rows."""
    spark, sc = every.sparkSession, every.sparkSession.sparkContext
    huge = huge.withColumn("asked", F.coalesce(query, F.lit(False)))
    exact = out.select("query_id", "row", F.udf(_sortable, "string")(F.col("score")).alias("rank_key"), "vec_id", "score")
    whole = lambda v, x: [int(e) for e in v] if v is not None else [math.floor(Fraction(float(e)) * Fraction(scale)) for e in x]
    low, high = -(1 << 63), (1 << 63) - 1
    sets = -(-huge.count() // 1024)
    for part in range(sets):
        own = sc.broadcast([(r["vec_id"], r["row"], whole(None, r["x"]), r["asked"]) for r in huge.filter(F.pmod(F.xxhash64("row"), F.lit(sets)) == part).collect()])  # about 1024 rows

        def run(batches: Iterator[pd.DataFrame], own=own) -> Iterator[pd.DataFrame]:
            best: dict[tuple[int, int], list[tuple[int, int]]] = {}

            def meet(q: int, row: int, x: list[int], c: int, y: list[int]) -> None:
                if q != c and len(x) == len(y):
                    heap = best.setdefault((q, row), [])
                    item = (sum(map(operator.mul, x, y)), -c)
                    heapq.heappush(heap, item) if len(heap) < k else heapq.heappushpop(heap, item)

            for b in batches:
                for c, row, v, x, asked in zip(b["vec_id"], b["row"], b["v"], b["x"], b["asked"], strict=True):
                    y = whole(v, x)
                    for q, own_row, z, own_asked in own.value:
                        if own_asked:
                            meet(q, own_row, z, c, y)
                        if asked and v is not None:  # large ones meet as queries
                            meet(c, row, y, q, z)
            rows = [(q, row, _sortable(s), -c, min(max(s, low), high)) for (q, row), heap in best.items() for s, c in heap]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _BEST.split(", ")])

        exact = exact.unionByName(every.withColumn("asked", F.coalesce(query, F.lit(False))).mapInPandas(run, _BEST))
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("rank_key"), "vec_id"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k)


def _answer(table: DataFrame, asked, n: int, k: int, cells: int, top: int) -> DataFrame:
    sc, exact = table.sparkSession.sparkContext, top < 2**52

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, _, q = asked.value
        for b in batches:
            for at in range(0, len(b), _ROWS):
                own = b["vec_id"].to_numpy()[at : at + _ROWS]
                c = np.stack(b["v"].to_numpy()[at : at + _ROWS]).astype(np.int64)
                for i in range(0, ids.size, _QUERIES):
                    yield np.arange(i, min(i + _QUERIES, ids.size)), own, _scores(q[i : i + _QUERIES], c, exact)

    # [low, low + cells * width) holds the kth score of each query; `above` scores lie beyond it.
    width = 1
    while cells * width < 2 * top + 2:
        width *= cells
    low, above = np.full(n, -top - 1, np.int64), np.zeros(n, np.int64)
    while True:
        state = sc.broadcast((low, width))

        def count(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            low, width = state.value
            ids = asked.value[0]
            sums = np.zeros(ids.size * cells, np.int64)
            for at, own, s in scored(batches):
                cell = (s - low[at][:, None]) // width
                ok = (cell >= 0) & (cell < cells) & (own[None, :] != ids[at][:, None])
                sums[at[0] * cells : (at[-1] + 1) * cells] += np.bincount((cell + (np.arange(at.size) * cells)[:, None])[ok], minlength=at.size * cells)
            key = np.flatnonzero(sums)
            number = sums[key]
            yield pd.DataFrame({"cell": key, "n": number})

        hist = table.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        # The cell with the kth highest: the last whose count from above is below k with it left out.
        beyond = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("cell"))) - F.col("n")
        hist = hist.withColumn("q", F.floor(F.col("cell") / cells)).withColumn("beyond", beyond)
        keep = F.col("beyond") < k if not above.any() else None
        if keep is None:
            need = pd.DataFrame({"q": np.arange(n), "need": k - above})
            hist = hist.join(F.broadcast(table.sparkSession.createDataFrame(need)), "q")
            keep = F.col("beyond") < F.col("need")
        at = hist.filter(keep).groupBy("q").agg(F.min(F.struct("cell", "beyond")).alias("x")).select("q", "x.*").toPandas()  # a row for each query
        q = at["q"].to_numpy().astype(np.int64)
        low, above = low.copy(), above.copy()
        low[q] += (at["cell"].to_numpy().astype(np.int64) - q * cells) * width
        above[q] += at["beyond"].to_numpy().astype(np.int64)
        if width == 1:
            break
        width //= cells
    kth = sc.broadcast(low)

    def keep_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = asked.value[0]
        for at, own, s in scored(batches):
            qi, ci = np.nonzero((s >= kth.value[at][:, None]) & (own[None, :] != ids[at][:, None]))
            score, vec = s[qi, ci], own[ci]
            order = np.lexsort((vec, -score, qi))
            qi, score, vec = qi[order], score[order], vec[order]
            rank = np.arange(qi.size) - np.searchsorted(qi, qi)
            ok = rank < k
            yield pd.DataFrame({"query_id": ids[at][qi[ok]], "row": asked.value[1][at][qi[ok]], "vec_id": vec[ok], "score": score[ok]})

    best = table.mapInPandas(keep_best, "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "row", "rank", "vec_id", "score")

"""Packing by patterns and non-negative least squares.

Documents become pieces of at most `room` tokens; only longer ones are cut, and the first piece takes what is over.
Of the pieces only the histogram of lengths (`room` numbers) comes to the driver. Patterns of up to four lengths that
fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded
down, and what is left is packed best-fit, longest first, on the histogram. Pieces then take the slots of their length
in the order of their rank, which is counted in salted runs so that no length meets in one task.

Null texts are empty; an empty text is one piece with the end token alone. Very long texts become many pieces. Equal
rows are packed one by one. An empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tokenizer_path, written
from .tokens import vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, room: int = 2048, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(tokenizer or tokenizer_path("byte_bpe_50k.json"))
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, found in zip(batch["doc_id"], words.encode([t or "" for t in batch["text"]]), strict=True):
                ids = found.astype("<u4").tobytes() + tail
                n = len(ids) >> 2
                first = (n - 1) % room + 1
                at = [0, *range(first, n + 1, room)]
                rows += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(at, at[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def patterns(counts: np.ndarray, room: int, seed: int, tries: int = 24) -> np.ndarray:
    """Rows of four lengths (0: none) that fill `room`, each pattern once; every length is in several."""
    rng = np.random.default_rng(seed)
    have = np.flatnonzero(counts)
    have = have[have > 0]
    p = counts[have] / counts[have].sum()
    one = np.repeat(have, tries)
    two = rng.choice(have, one.size, p=p)
    three = rng.choice(have, one.size, p=p)
    none = np.zeros_like(one)
    found = [
        np.stack([have, room - have, 0 * have, 0 * have], 1),
        np.stack([one, two, room - one - two, none], 1),
        np.stack([one, two, three, room - one - two - three], 1),
        np.stack([have, 0 * have, 0 * have, 0 * have], 1),
    ]
    rows = np.concatenate(found)
    rows = rows[(rows >= 0).all(1)]
    rows = rows[((rows == 0) | (counts[np.clip(rows, 0, room)] > 0)).all(1)]
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def nnls(rows: np.ndarray, counts: np.ndarray, waste: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|^2, with a little weight against patterns that waste room; accelerated projected gradient."""
    live, room = rows > 0, counts.size
    flat, col = rows[live], np.nonzero(live)[0]
    forward = lambda x: np.bincount(flat, x[col], room)
    back = lambda r: np.bincount(col, r[flat], len(rows))
    x = np.ones(len(rows))
    for _ in range(30):
        x = back(forward(x))
        x /= np.linalg.norm(x)
    size = np.linalg.norm(back(forward(x))) * 1.05
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - (back(forward(y) - counts) + waste) / size)
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (old - 1) / t * (new - x), new
    return x


def plan(counts: np.ndarray, room: int, seed: int = 3) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) for each kind of sequence; together they hold exactly `counts[length]` pieces of each length."""
    left, out = counts.astype(np.int64).copy(), []
    if left[room]:
        out.append((int(left[room]), (room,)))
        left[room] = 0
    if left.sum():
        rows = patterns(left, room, seed)
        empty = room - rows.sum(1)
        x = nnls(rows, left.astype(float), 1e-3 * empty * left.max() / room)
        for k in np.argsort(empty, kind="stable"):
            lengths = rows[k][rows[k] > 0]
            times = int(x[k] + 1e-9)
            if empty[k] or not times:
                continue
            for n, m in zip(*np.unique(lengths, return_counts=True), strict=True):
                times = min(times, int(left[n]) // int(m))
            if times > 0:
                np.subtract.at(left, lengths, times)
                out.append((times, tuple(map(int, lengths))))
    # Best fit, longest first, for what the patterns left; bins with equal room and content are kept together.
    bins: dict[int, list[list]] = {}
    spaces: np.ndarray = np.zeros(room + 1, np.int64)
    for n in range(room, 0, -1):
        todo = int(left[n])
        while todo:
            fit = np.flatnonzero(spaces[n:])
            space = n + int(fit[0]) if fit.size else room
            if not fit.size:
                # A bin for each would leave those that fit together apart: open as many as they need.
                each = room // n
                full, some = divmod(todo, each)
                for times, m in ((full, each), (1 if some else 0, some)):
                    if times:
                        bins.setdefault(room - m * n, []).append([times, (n,) * m])
                        spaces[room - m * n] += times
                todo = 0
                continue
            times, inside = bins[space].pop()
            use = min(times, todo)
            if times > use:
                bins[space].append([times - use, inside])
            spaces[space] -= use
            todo -= use
            bins.setdefault(space - n, []).append([use, (*inside, n)])
            spaces[space - n] += use
    return out + [(t, inside) for group in bins.values() for t, inside in group]


def slots(kinds: list[tuple[int, tuple[int, ...]]], room: int) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that share a kind of sequence and a place in it."""
    length, times, sequence, offset, base = [], [], [], [], 0
    for n, inside in kinds:
        at = 0
        for x in inside:
            length.append(x), times.append(n), sequence.append(base), offset.append(at)
            at += x
        base += n
    length, times = np.array(length, np.int64), np.array(times, np.int64)
    order = np.argsort(length, kind="stable")
    length, times = length[order], times[order]
    start = np.cumsum(times) - times
    first = np.searchsorted(length, np.arange(room + 2))
    start -= start[first[length]] if length.size else 0
    return {"length": length, "start": start, "sequence": np.array(sequence, np.int64)[order], "offset": np.array(offset, np.int64)[order]}


def pack(docs: DataFrame, room: int = 2048, tokenizer: str | None = None, end: int = 0, seed: int = 3) -> DataFrame:
    """PIECES and sequence_id, offset: the pieces in as few sequences as the plan finds."""
    spark = docs.sparkSession
    cut = written(pieces(docs, room, tokenizer, end), "pieces")
    counts = np.zeros(room + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `room` rows
        counts[r["length"]] = r["count"]
    table = spark.sparkContext.broadcast(slots(plan(counts, room, seed), room))
    salts = max(1, math.isqrt(int(counts.sum())))
    rows = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    base = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    base = base.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    rows = rows.withColumn("_rank", rank.cast("long")).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base") - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, far = table.value, np.int64(1) << 50
        keys = t["length"] * far + t["start"]
        for b in batches:
            n, r = b["length"].to_numpy(), b["_rank"].to_numpy()
            k = np.searchsorted(keys, n * far + r, "right") - 1
            yield b.drop(columns="_rank").assign(sequence_id=t["sequence"][k] + r - t["start"][k], offset=t["offset"][k])

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")

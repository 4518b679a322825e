"""SimHash near-duplicates by a self-join over a binary trie of fingerprints.

A fingerprint is made of the hashes of a text's word shingles. Rows are first brought together by fingerprint, so
that copies never multiply. Two fingerprints that differ in at most `bits` bits agree in one of `bits` + 1 blocks, so
the distinct ones are dealt out by each block's value; buckets that are still large are dealt out again by blocks of
the bits that remain, until they are small or no bit is left. In a bucket node pairs of the binary trie are traversed
together: the differing bits add up, and a pair is dropped beyond the budget or when all below it is linked already.
Only a spanning forest of each bucket leaves it. Components come from alternating star contractions in DataFrames.

Null and empty texts have fingerprint zero, linked like any other. A text of fewer words than a shingle has the one
shingle of all its words. Very long texts are hashed whole. Equal rows share a fingerprint. An empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import columns, located, partitions, scratch, small, written
from .trie import majority, trie_forest

#: Distinct fingerprints that a bucket holds before it is dealt out again.
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in b], np.uint64).astype(np.int64))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select("doc_id", F.pandas_udf(run, "long")(F.col("text")).alias("fp"))


def _cut(open_: list[int], parts: int) -> list[list[int]]:
    return [open_[len(open_) * k // parts : len(open_) * (k + 1) // parts] for k in range(parts)]


def open_blocks(path: str, bits: int) -> list[list[int]]:
    """The bits that a path of blocks ("2;0;" is block 0 of what block 2 left) leaves open, in bits + 1 blocks."""
    left = list(range(64))
    for k in path.split(";")[:-1]:
        own = _cut(left, bits + 1)[int(k)]
        left = [x for x in left if x not in own]
    return _cut(left, bits + 1)


def open_bits(level: int, bits: int) -> list[list[int]]:
    """What paths of that length leave open at least and at most: always the first, always the last block."""
    return [sum(open_blocks(f"{k};" * level, bits), []) for k in (0, bits)]


def near_links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b) fingerprints, a forest that connects all of `distinct` within `bits` of each other. `distinct`: column fp, each once."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each fingerprint of a bucket goes to one bucket for each block of the bits that the key leaves open."""
        blocks: dict[str, list[list[int]]] = {}
        for b in batches:
            out: list[tuple[int, str]] = []
            for fp, key in zip(b["fp"].tolist(), b["key"], strict=True):
                path = re.sub(r"/\d+", "", key)
                own = blocks.get(path) or blocks.setdefault(path, open_blocks(path, bits))
                out += [(fp, f"{key}{k}/{sum((fp >> x & 1) << i for i, x in enumerate(block))};") for k, block in enumerate(own)]
            yield pd.DataFrame(out, columns=["fp", "key"])

    rows = distinct.select("fp", F.lit("").alias("key")).mapInPandas(deal, "fp long, key string")
    done: list[DataFrame] = []
    for level in range(1, 64):
        # Buckets that are still large are dealt out again, while more bits are open than may differ.
        full = written(rows.groupBy("key").count().filter(F.col("count") > BUCKET).select(F.col("key").alias("_key")), "full")
        last = min((len(x) for x in open_bits(level, bits)), default=0) <= bits
        if last or not full.limit(1).count():
            done.append(rows)
            break
        rows = written(rows, "dealt")
        done.append(rows.join(small(full), F.col("key") == F.col("_key"), "left_anti"))
        rows = rows.join(small(full), F.col("key") == F.col("_key")).select("fp", "key").mapInPandas(deal, "fp long, key string")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            fp = pdf["fp"].to_numpy().astype(np.uint64)
            bucket = np.r_[0, np.cumsum(pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1])]
            order = np.lexsort((fp, bucket))
            a, b = trie_forest(bucket, fp[order], bits)
            s = fp[order].astype(np.int64)
            return pd.DataFrame({"a": s[a], "b": s[b]})

        for b in batches:
            held.append(b)
            pdf = pd.concat(held, ignore_index=True)
            at = int(np.flatnonzero((pdf["key"] != pdf["key"].iat[-1]).to_numpy()).max(initial=-1)) + 1
            if at:
                yield solve(pdf.iloc[:at])
            held = [pdf.iloc[at:]]
        if held and sum(map(len, held)):
            yield solve(pd.concat(held, ignore_index=True))

    # The number of partitions is the session's; a bucket is in one of them, in one run of rows.
    return out.repartition(partitions(distinct), "key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each linked node, root the smallest of its component, by alternating large and small stars.

    A node's smallest neighbour is an aggregate, joined back; so a node with many links is never gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        joined = large.join(low, F.col("u") == F.col("_u"))
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()
        star = written(star, "small")
        same = edges.count() == star.count() and not edges.join(star, ["u", "v"], "left_anti").limit(1).count()
        edges = star
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id of those that links reach."""
    return settled(written(fingerprints(docs, shingle, seed), "prints"), lambda fps: near_links(fps, bits))


def settled(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`prints` (doc_id, fp; written) with component_id, from what `links` makes of the distinct fp."""
    with scratch(prints.sparkSession):
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
        roots = components(links(distinct.select("fp")))
        own = distinct.join(roots, F.col("fp") == F.col("node"))
        whole = own.groupBy("root").agg(F.min("least").alias("m"))
        # The root itself is linked but has no row of its own in `roots`.
        tops = distinct.join(whole, F.col("fp") == F.col("root")).select("root", F.least("least", "m").alias("component"))
        of = own.join(tops.withColumnRenamed("root", "_r"), F.col("root") == F.col("_r")).select("fp", "component").unionByName(tops.select(F.col("root").alias("fp"), "component"))
        # Fingerprints of one document without links need no table.
        table = distinct.join(of.withColumnRenamed("fp", "_f"), F.col("fp") == F.col("_f"), "left").filter("n > 1 OR component IS NOT NULL")
        table = written(table.select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("_c")), "table", keep=True)
    return prints.join(small(table), F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", F.coalesce("_c", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their component; of rows that share it, or have none, the first.

    Links are pairs whose sets of word shingles have at least that Jaccard similarity, found by the trie join within
    the buckets of similar.py and checked exactly. Rows go by their locators, so repeated and null ids are no matter.
    """
    rows, at = located(docs, "rows")
    with scratch(docs.sparkSession):
        prints = written(similar.keys(rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.col(f"{at}.file").alias("file"), F.col(f"{at}.row").alias("row"), "text")), "keys")
        top = settled(prints.select(F.struct("ord", "file", "row").alias("doc_id"), "fp"), lambda _: similar.similar_links(rows, at, prints, shingle, similarity, components))
        gone = top.filter("doc_id <> component_id").select(F.struct("doc_id.file", "doc_id.row").alias(at))
        gone = written(gone, "gone", keep=True)
    return rows.join(small(gone), at, "left_anti").select(*columns(docs))

"""Links between texts whose sets of word shingles have a Jaccard similarity of at least `least`, by the trie self-join.

At 0.8 some ten of 64 SimHash bits differ, too many for blocks of bits that agree to deal fingerprints out. So for
this join the buckets come from the sets: put into one order, rare shingles first, two sets of that similarity share a
shingle among the first |x| - ceil(least |x|) + 1 of each, so texts that share one of those are a bucket. The order
decides about work only, never about results; what is common is guessed from a sample of all texts. In each bucket the fingerprints
are joined by their trie with a budget of BITS differing bits, which drops most of what shares a passage only; and a pair has to share
as many shingles of its prefixes as similar ones do (see _enough). Every pair that remains is checked with the whole sets.

What the budget can lose: a bit of two texts of similarity 0.8 differs with a probability of about 0.15 (of 5 shingles
against 4 of them: 0.19), so more than BITS of 64 differ in less than one of 100,000 such pairs.

Small buckets give all their pairs within the budget. Large ones first link their members
to one of them; what then is still in different components there is joined by the trie, which drops node pairs of one component, so that many copies of one
text don't give the pairs of them all; there sketches of the sets (least hashes of bins) also drop what can't be similar, at five
standard deviations, and only a forest of what may be similar leaves a bucket. What it connects is a group, to which each text takes its
whole set once, however many buckets it is in; sets are compared there. What a pair shares is counted over all its buckets. Shingles stand by 64-bit hashes, texts by the hash of their words in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch, small, written
from .trie import majority, trie_pairs

#: Bits that fingerprints may differ in: see above.
BITS = 26
#: Texts up to which a bucket gives all its pairs at once; rows read at a time.
BUCKET, ROWS = 32, 1 << 15
#: One of so many texts is in the sample, how many of them have a common shingle, and how many shingles are told apart so
#: (which bounds what is collected and broadcast; the least frequent ones count as rare beyond it).
SAMPLE, COMMON, MOST = 8, 4, 1 << 20
_PAIR = "a long, b long"


def shingles(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """The key of a text, as a signed number, and the hashes of its shingles, sorted, each once."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    key = xxhash.xxh64_intdigest(line, 7)
    key -= (key >> 63) << 64
    n = len(words) - shingle + 1
    if n <= 1:
        return key, np.array([xxhash.xxh64_intdigest(line, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return key, np.unique(np.fromiter((h(line[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def key(text: str | None) -> int:
    k = xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 7)
    return k - ((k >> 63) << 64)


def keys(rows: DataFrame) -> DataFrame:
    """ord, file, row (passed on) and fp, the key of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["ord", "file", "row"]].assign(fp=np.array([key(t) for t in b["text"]], np.int64))

    return rows.mapInPandas(run, "ord long, file long, row long, fp long")


def common(docs: DataFrame, shingle: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and how many have each; the MOST most frequent.

    Of each text of the sample, those that come first by their hashes, twice as many as its prefix has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, shingle)[1] for t in b["text"]]
            yield pd.DataFrame({"token": np.concatenate([np.zeros(0, np.uint64), *(s[: 2 * _prefix(s.size, least)] for s in sets)]).astype(np.int64)})

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInPandas(run, "token long")
    rows = some.groupBy("token").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST).collect()
    token = np.array([r[0] for r in rows], np.int64).astype(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r[1] for r in rows], np.int64)[order]


def _prefix(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def prefixes(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """token, k (the text's key), n (size of its set) and fp (its fingerprint); a text once in a task."""
    often, times = common(docs, shingle, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out: list[tuple[np.ndarray, int, int, int]] = []
            for t in b["text"]:
                k, s = shingles(t, shingle)
                if k in seen or not s.size:
                    continue
                seen.add(k)
                rank = np.zeros(s.size, np.int64)
                if often.size:
                    place = np.minimum(np.searchsorted(often, s), often.size - 1)
                    rank = np.where(often[place] == s, times[place], 0)
                out.append((s[np.lexsort((s, rank))][: _prefix(s.size, least)], k, s.size, majority(s)))
            sizes = [x[0].size for x in out]
            token = np.concatenate([x[0] for x in out] or [np.zeros(0, np.uint64)]).astype(np.int64)
            yield pd.DataFrame({"token": token} | {c: np.repeat(np.array([x[j] for x in out], kind), sizes).astype(np.dtype(kind.__name__.removeprefix("u"))) for j, (c, kind) in enumerate((("k", np.int64), ("n", np.int32), ("fp", np.uint64)), 1)})

    return docs.select("text").mapInPandas(run, "token long, k long, n int, fp long")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by token, put together and cut so that a token's rows are in one of them; (token, k) once."""
    held: list[pd.DataFrame] = []
    size, full = 0, ROWS

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        token, k = pdf["token"].to_numpy(), pdf["k"].to_numpy()
        return pdf[np.r_[True, (token[1:] != token[:-1]) | (k[1:] != k[:-1])]]

    for b in batches:
        held.append(b)
        size += len(b)
        if size < full:
            continue
        pdf = pd.concat(held, ignore_index=True)
        at = int(np.flatnonzero((pdf["token"] != pdf["token"].iat[-1]).to_numpy()).max(initial=-1)) + 1
        if at:
            yield once(pdf.iloc[:at])
        held = [pdf.iloc[at:]]
        size -= at
        full = max(ROWS, 2 * size)
    if size:
        yield once(pd.concat(held, ignore_index=True))


def _bounds(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    return first, np.r_[first[1:], token.size]


def _sizes(n: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    return np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9


#: Bins of a sketch, of four bits each.
BINS = 512


def sketch(s: np.ndarray) -> bytes:
    """For each bin of the shingles' hashes four bits of its least one; 0 where it has none."""
    out = np.zeros(BINS, np.uint8)
    if s.size:
        cell = (s >> np.uint64(55)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out[cell[first]] = (s[first] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(15) + np.uint64(1)
    return out.tobytes()


#: Shingles up to which a text takes its set to the buckets in place of a sketch.
SHORT = 64


def brief(s: np.ndarray) -> bytes:
    """A short set as it is, else its sketch, two bins a byte."""
    if s.size <= SHORT:
        return s.tobytes()
    bins = np.frombuffer(sketch(s), np.uint8)
    return (bins[::2] | bins[1::2] << 4).tobytes()


def unbrief(of: bytes, n: int) -> tuple[np.ndarray | None, bytes]:
    """The set of n shingles if it is short, and its sketch."""
    if n <= SHORT:
        s = np.frombuffer(of, np.uint64)
        return s, sketch(s)
    two = np.frombuffer(of, np.uint8)
    return None, np.stack([two & 15, two >> 4], 1).tobytes()


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of that similarity can have these sketches: five standard deviations below what they agree in."""
    used = ((a > 0) | (b > 0)).sum(1)
    p = least + (1 - least) / 16
    return ((a == b) & (a > 0)).sum(1) >= used * p - 5 * np.sqrt(used * p * (1 - p)) - 1


def _frame(k: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    swap = k[i] > k[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pd.DataFrame({"a": k[i], "b": k[j], "na": n[i], "nb": n[j]})


def _enough(least: float) -> Column:
    """Whether two texts share as many shingles of their prefixes (`count`) as similar ones do.

    Those share c >= least / (1 + least) (|x| + |y|) in all, and l of them are among the first |x| - c + l and |y| - c + l.
    """
    c = F.ceil((F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - 1e-6)
    most = F.greatest("na", "nb")
    return (F.least("na", "nb") >= most * F.lit(least) - 1e-9) & (F.col("count") >= c + 1 - F.ceil(most * F.lit(least) - 1e-9))


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs that are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                ok.append(both >= least * (x.size + y.size - both) - 1e-9)
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    out = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
    return out.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb").mapInPandas(run, _PAIR)


def similar_links(docs: DataFrame, at: str, prints: DataFrame, shingle: int, least: float, components) -> DataFrame:
    """(a, b) keys; they connect all texts that are similar enough, and only such. at: locators; prints: see `keys`."""
    rows = prefixes(docs, shingle, least).repartition(partitions(docs), "token").sortWithinPartitions("token", "k")

    def joined(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs by the buckets' tries."""
        token, k, n, fp = (pdf[c].to_numpy() for c in ("token", "k", "n", "fp"))
        fp = fp.astype(np.uint64)
        order = np.lexsort((k, fp, token))
        for i, j in trie_pairs(token[order], fp[order], BITS):
            i, j = order[i], order[j]
            ok = _sizes(n, i, j, least)
            yield _frame(k, n, i[ok], j[ok])

    def bring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of small buckets; members of large ones, paired with one of them."""
        for pdf in _runs(batches):
            token, k, n = (pdf[c].to_numpy() for c in ("token", "k", "n"))
            first, last = _bounds(token)
            some = np.repeat((last - first > 1) & (last - first <= BUCKET), last - first)
            for pairs in joined(pdf[some]):
                yield pairs.assign(token=0, fp=0, large=False)
            for i, j in zip(first[last - first > BUCKET].tolist(), last[last - first > BUCKET].tolist(), strict=True):
                one = i + int(np.argmin(k[i:j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                yield pd.DataFrame({"a": k[i:j], "b": k[one], "na": n[i:j], "nb": n[one], "token": token[i:j], "fp": pdf["fp"].to_numpy()[i:j], "large": True})

    found = written(rows.mapInPandas(bring, f"{_PAIR}, na int, nb int, token long, fp long, large boolean"), "candidates")
    up, down = F.col("a") < F.col("b"), F.col("a") > F.col("b")
    ordered = found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(down, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("nb"), "large")
    pairs = written(ordered.groupBy("a", "b", "na", "nb").count().filter(_enough(least)).select("a", "b"), "pairs")

    def texts(ids: DataFrame) -> DataFrame:
        """k and text, one of each key, by its locator. ids: _k"""
        one = prints.join(small(ids), F.col("fp") == F.col("_k")).groupBy(F.col("fp").alias("k")).agg(F.min(F.struct("file", "row")).alias("_at"))
        return docs.select(at, "text").join(small(written(one, "ids")), F.col(at) == F.col("_at")).select("k", "text")

    def made(**of: Callable[[np.ndarray], bytes]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sets = [shingles(t, shingle)[1] for t in b["text"]]
                yield pd.DataFrame({"k": b["k"]} | {c: list(map(f, sets)) for c, f in of.items()})

        return run

    def checked(pairs: DataFrame) -> DataFrame:
        with scratch(docs.sparkSession):
            ids = written(pairs.select(F.explode(F.array("a", "b")).alias("_k")).distinct(), "ids")
            sets = texts(ids).mapInPandas(made(s=np.ndarray.tobytes), "k long, s binary")
            return written(_checked(pairs, written(sets, "sets"), least), "links", keep=True)

    def members(links: DataFrame) -> DataFrame:
        """_n and root, of the roots too."""
        tops = components(links)
        return tops.unionByName(tops.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "_n")

    links = checked(pairs)
    large = found.filter("large").select("token", F.col("a").alias("k"), F.col("na").alias("n"), "fp")
    if not large.limit(1).count():
        return links
    parts = large.join(small(written(members(links), "parts")), F.col("k") == F.col("_n"), "left").select("token", "k", "n", "fp", F.coalesce("root", "k").alias("part"))
    # Buckets that links have connected need no more; of buckets that have the same texts, one is enough.
    open_ = parts.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("k")).alias("u"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("v"))
    open_ = written(open_.filter("x <> y").groupBy("size", "u", "v").agg(F.min("token").alias("_t")).select("_t"), "open")
    parts = written(parts.join(small(open_), F.col("token") == F.col("_t"), "left_semi"), "parts")
    ids = written(parts.select(F.col("k").alias("_k")).distinct(), "ids")
    sets = written(texts(ids).mapInPandas(made(s=np.ndarray.tobytes, short=brief), "k long, s binary, short binary"), "sets").withColumnRenamed("k", "_k")

    def tied(end: str, of: Callable[[pd.DataFrame], list[tuple[np.ndarray | None, bytes]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """A forest of the pairs of different parts in a bucket that are similar, or may be if `of` has not both their sets."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _runs(batches):
                order = np.lexsort((pdf["k"].to_numpy(), pdf["fp"].to_numpy().astype(np.uint64), pdf["token"].to_numpy()))
                pdf = pdf.iloc[order]
                token, n, fp, ends = (pdf[c].to_numpy() for c in ("token", "n", "fp", end))
                label = np.unique(pdf["part"].to_numpy(), return_inverse=True)[1]
                known = of(pdf)
                own = [x[0] for x in known]
                drawn = np.frombuffer(b"".join(x[1] for x in known), np.uint8).reshape(-1, BINS)
                found = []
                for i, j in trie_pairs(token, fp.astype(np.uint64), BITS, label, joins=True):
                    ok = _sizes(n, i, j, least)
                    i, j = i[ok], j[ok]
                    ok = _alike(drawn[i], drawn[j], least)
                    for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                        if label[x] == label[y]:
                            continue
                        a, b = own[x], own[y]
                        if a is not None and b is not None:
                            both = int((b[np.minimum(np.searchsorted(b, a), b.size - 1)] == a).sum())
                            if both < least * (a.size + b.size - both) - 1e-9:
                                continue
                        found.append((ends[x], ends[y]))
                        label[label == label[x]] = label[y]
                yield pd.DataFrame(found, columns=["a", "b"])

        return run

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(docs), "token").sortWithinPartitions("token", "k")

    # Buckets see sketches, and find what may connect their parts; sets go to what is so connected, each once.
    seen = dealt(parts.join(sets.select("_k", "short"), F.col("k") == F.col("_k")).drop("_k"))
    maybe = written(seen.mapInPandas(tied("part", lambda pdf: [unbrief(*x) for x in zip(pdf["short"], pdf["n"], strict=True)]), _PAIR), "maybe")
    groups = parts.select("k", "n", "fp", "part").distinct().join(small(written(members(maybe), "groups")), F.col("part") == F.col("_n"))
    groups = small(written(groups.select(F.col("root").alias("token"), "k", "n", "fp", "part"), "groups"))

    def whole(pdf: pd.DataFrame) -> list[tuple[np.ndarray, bytes]]:
        return [(s, sketch(s)) for s in (np.frombuffer(x, np.uint64) for x in pdf["s"])]

    late = dealt(sets.select("_k", "s").join(groups, F.col("k") == F.col("_k")).drop("_k")).mapInPandas(tied("k", whole), _PAIR)
    return links.unionByName(written(late, "links"))

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased; each run of other characters than letters counts as one space. The n-grams of two and three
characters of whole texts fall into 2^15 buckets. Counts of a bounded sample of labelled documents (by a hash of
doc_id, `sample` for each language as expected) give a smoothed matrix of log probabilities, which is broadcast
(languages x 2^15 numbers); documents are scored by gathering its rows in numpy, a batch of documents at a time.

Null texts and texts without a letter are `und` with score 0; so are all where nothing could be learned. The score is
the posterior of the predicted language under equal priors; ties go to the language first by code point. Rows with a
null language aren't learned from. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

BUCKETS = 1 << 15
#: Characters that are scored together, which bounds a worker's memory; a longer text is scored alone.
CHUNK = 1 << 18
#: Languages beyond this number are not expected; the matrix would no longer be small.
MOST_LANGUAGES = 1000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and the text that each is of."""
    points = np.frombuffer(" ".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # Lower-casing may lengthen a text; its end is found again by its own length.
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    letter = _letters()[points]
    first = np.ones(points.size, bool)
    first[1:] = letter[:-1]
    keep = letter | first
    of = np.searchsorted(ends, np.flatnonzero(keep), "right")
    c = np.where(letter, points, 32)[keep].astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    two = (c[:-1] * mix) ^ c[1:]
    three = (two[:-1] * mix) ^ c[2:]
    shift = np.uint64(49)
    g = np.concatenate([(two * mix) >> shift, ((three * mix + mix) * mix) >> shift]).astype(np.int64)
    owner = np.concatenate([of[:-1], of[:-2]])
    whole = np.concatenate([of[:-1] == of[1:], of[:-2] == of[2:]])
    return g[whole], owner[whole]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > CHUNK:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def train(labelled: DataFrame, sample: int = 4000) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [bucket, language]) of rows with `text`, `lang` and `doc_id`."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    part = F.lit(1.0)
    for lang in langs:
        part = F.when(F.col("lang") == lang, min(1.0, sample / sizes[lang])).otherwise(part)
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1 << 20)) < part * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            for lang, own in b.groupby("lang"):
                texts = own["text"].tolist()
                for i, j in _chunks(texts):
                    sums[langs.index(lang)] += np.bincount(grams(texts[i:j])[0], minlength=BUCKETS)
        yield pd.DataFrame({"k": range(len(langs)), "sums": [s.astype("<i8").tobytes() for s in sums]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[-1]], "sums": [sum(np.frombuffer(s, "<i8") for s in pdf["sums"]).astype("<i8").tobytes()]})

    # As many tables as tasks; they are added in bundles before each language's are added up.
    part = chosen.mapInPandas(count, "k int, sums binary").withColumn("bundle", F.spark_partition_id() % 32)
    part = part.groupBy("bundle", "k").applyInPandas(add, "k int, sums binary").groupBy("k").applyInPandas(add, "k int, sums binary")
    sums = np.zeros((BUCKETS, len(langs)))
    for r in part.collect():  # a row for each language
        sums[:, r["k"]] = np.frombuffer(r["sums"], "<i8")
    odds = np.log((sums + 0.5) / (sums + 0.5).sum(0))
    return langs, odds.astype(np.float32)


def predicted(text: Column, langs: list[str], odds: np.ndarray, sc) -> Column:
    """A struct of lang_pred and score for each whole text."""
    model = sc.broadcast(odds)
    names = np.array([*langs, "und"], object)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b]
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            for i, j in _chunks(texts) if langs else ():
                some = np.array([any(map(str.isalpha, t)) for t in texts[i:j]])
                g, of = grams(texts[i:j])
                total = np.stack([np.bincount(of, model.value[:, k][g], j - i) for k in range(len(langs))], 1)
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                at = p.argmax(1)
                best[i:j] = np.where(some, at, len(langs))
                score[i:j] = np.where(some, p[np.arange(j - i), at], 0.0)
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double")(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _learned(docs: DataFrame, sample: int) -> Column:
    langs, odds = train(docs.filter(~_out(docs)), sample)
    return predicted(F.col("text"), langs, odds, docs.sparkSession.sparkContext)


def _out(docs: DataFrame) -> Column:
    return F.coalesce(held_out(docs["doc_id"]), F.lit(False))


def identify(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that aren't held out."""
    out = docs.select("doc_id", _out(docs).alias("held_out"), _learned(docs, sample).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def accepted(docs: DataFrame, least: float = 0.5, sample: int = 4000) -> DataFrame:
    """The rows of `docs` whose text has a language with a posterior of `least` or more."""
    out = docs.select(F.struct(*columns(docs)).alias("_row"), _learned(docs, sample).alias("_p"))
    return out.filter((F.col("_p.lang_pred") != "und") & (F.col("_p.score") >= least)).select("_row.*")

"""Exact deduplication by a stateful stream.

Documents are written to the shared folder with their digests, which gives each a locator: the part (one for each set of documents) and its row
there. Digest, identifier, size and locator go through a stream with a state for each digest, kept on disk
(RocksDB) and never expired: how many rows had it, and identifier, size and locator of the row that stays. Rows that hit
a digest are then read by their locators together with the row that stays, and their full bytes are compared. Should
any differ, the state is built anew from the written documents with two more digests, and the check is made again. The
stream can be continued with later documents.

Texts are equal when the same without the white space of SPACE; null counts as empty, so null and empty texts are
one group. Of equal texts the one with the most code points stays, then the smallest doc_id (null last), then the first
by locator. Decisions are taken by locator: equal rows, and rows that share a doc_id or have none, count one by one and
one of a group stays. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, delete, exists, located, make_dir, new_path, scratch, small, writing, written

_LAST = (1 << 63) - 1
#: Rows for which a store is made.
STORE = 50_000
_DIGESTS = "doc_id long, ord long, n_points long, digest string, part int, row long, at struct<file:long,row:long>"
_ROWS = f"{_DIGESTS}, text string"
_GROUPS = "digest string, group_size long, keep_id long, keep_part int, keep_row long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bare(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, b" \t\n\x0b\x0c\r")


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


class Deduplicator:
    """State under `home` in the shared folder; each `add` continues the stream over one more set of documents."""

    def __init__(self, spark: SparkSession, home: str | None = None, digest: Callable[[bytes], str] = sha256):
        self.spark, self.home, self.digest = spark, home or new_path(spark, "dedup"), digest

    @property
    def strong(self) -> bool:
        """Whether texts that differ had one digest."""
        return exists(self.spark, f"{self.home}/strong")

    def _state(self, what: str) -> str:
        return f"{self.home}/{'strong' if self.strong else 'plain'}/{what}"

    def parts(self) -> int:
        n = 0
        while exists(self.spark, f"{self.home}/part-{n}"):
            n += 1
        return n

    def add(self, docs: DataFrame) -> int:
        """Adds a set of documents (doc_id and text; at, if it has one, is kept with their digests); its part."""
        part = self.parts()
        at = F.col("at") if "at" in docs.columns else F.lit(None)
        self._digested(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", at.cast("struct<file:long,row:long>").alias("at"), F.lit(part).alias("part"), F.monotonically_increasing_id().alias("row")))
        self._advance(part)
        if self._differing(part) and not self.strong:
            self.spark.createDataFrame([(part,)], "since int").write.parquet(f"{self.home}/strong")
            self._digested(self.spark.read.schema(_ROWS).parquet(f"{self.home}/plain/rows").drop("ord", "n_points", "digest"))
            self._advance(part)
            if any(self._differing(k) for k in range(part + 1)):
                raise ValueError("texts that differ have the same three digests")
        return part

    def _digested(self, docs: DataFrame) -> None:
        digest, strong = self.digest, self.strong

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = [bare(t) for t in b]
                yield pd.DataFrame({"digest": [digest(t) + (sha256(t) + hashlib.blake2b(t).hexdigest() if strong else "") for t in own], "n_points": [len(t or "") for t in b]})

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        rows = docs.select("*", F.pandas_udf(run, "digest string, n_points long")(F.col("text")).alias("_d"))
        rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), "_d.n_points", "_d.digest", "part", "row", "at", "text")
        with writing(self.spark):
            rows.write.mode("append").option("compression", "zstd").parquet(self._state("rows"))

    def _advance(self, part: int) -> None:
        conf = self.spark.conf
        keys = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8"}  # many small stores: little room set aside for each
        # Stores for what there is when the state begins; each is on disk and may grow.
        stores = max(self.spark.sparkContext.defaultParallelism, -(-self.rows().count() // STORE))
        keys["spark.sql.shuffle.partitions"] = str(stores)
        before = {k: conf.get(k, None) for k in keys}
        for k, v in keys.items():
            conf.set(k, v)
        try:
            best = F.max(F.struct("n_points", (-F.col("ord")).alias("_ord"), (-F.col("part")).alias("_part"), (-F.col("row")).alias("_row"), "doc_id"))
            groups = self.spark.readStream.schema(_DIGESTS).parquet(self._state("rows")).groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("_best"))
            to = self._state("groups")

            def keep(batch: DataFrame, epoch: int) -> None:
                best = [F.col("_best.doc_id").alias("keep_id"), (-F.col("_best._part")).alias("keep_part"), (-F.col("_best._row")).alias("keep_row")]
                batch.select("digest", "group_size", *best, F.lit(epoch).alias("epoch")).write.mode("overwrite").parquet(f"{to}/epoch={epoch}")

            query = groups.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", self._state("state")).trigger(availableNow=True).start()
            query.awaitTermination()
            if not exists(self.spark, f"{self.home}/part-{part}"):
                make_dir(self.spark, f"{self.home}/part-{part}")
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def _differing(self, part: int) -> bool:
        """Whether rows of a part that hit a digest differ in their bytes from each other or from the row that stays."""
        rows, groups = self.rows().filter(F.col("part") == part), self.groups().filter("group_size > 1")
        hits = rows.join(small(groups.select("digest", "keep_part", "keep_row")), "digest")
        places = hits.select("digest", "part", "row").unionByName(hits.select("digest", F.col("keep_part").alias("part"), F.col("keep_row").alias("row")).distinct())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"digest": b["digest"], "bytes": [bare(t) for t in b["text"]]}).drop_duplicates()

        own = small(places.select(F.col("digest").alias("_d"), F.col("part").alias("_p"), F.col("row").alias("_at")))
        texts = self.spark.read.schema(_ROWS).parquet(self._state("rows")).select("part", "row", "text")
        found = texts.join(own, (F.col("row") == F.col("_at")) & (F.col("part") == F.col("_p"))).select(F.col("_d").alias("digest"), "text").mapInPandas(run, "digest string, bytes binary")
        # Copies meet in each task before they are dealt out.
        return bool(found.groupBy("digest", "bytes").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())

    def groups(self) -> DataFrame:
        """digest, group_size, and keep_id, keep_part and keep_row of the row that stays: the newest of each digest."""
        path = self._state("groups")
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], _GROUPS)
        rows = self.spark.read.schema(f"{_GROUPS}, epoch int").parquet(path)
        own = [x.split()[0] for x in _GROUPS.split(", ")[1:]]
        newest = rows.groupBy("digest").agg(F.max(F.struct("epoch", *own)).alias("_x"))
        return newest.select("digest", *(f"_x.{k}" for k in own))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_DIGESTS).parquet(self._state("rows"))


def _decided(state: Deduplicator) -> DataFrame:
    """doc_id, digest, at, keep_id, group_size, kept of all documents added."""
    shared = small(state.groups().filter("group_size > 1").withColumnRenamed("digest", "_d"))
    rows = state.rows().join(shared, F.col("digest") == F.col("_d"), "left")
    alone = F.col("_d").isNull()
    kept = alone | (F.col("part") == F.col("keep_part")) & (F.col("row") == F.col("keep_row"))
    return rows.select("doc_id", "digest", "at", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; a row for each document."""
    state = Deduplicator(docs.sparkSession)
    state.add(docs.select("doc_id", "text"))
    return _decided(state).select("doc_id", "keep_id", "group_size", "kept", F.substring("digest", 1, 64).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay."""
    rows, at = located(docs, "rows")
    state = Deduplicator(docs.sparkSession)
    with scratch(docs.sparkSession):
        state.add(rows.select("doc_id", "text", F.col(at).alias("at")))
        gone = written(_decided(state).filter(~F.col("kept")).select(F.col("at").alias(at)), "gone", keep=True)
    delete(docs.sparkSession, state.home)
    return rows.join(small(gone), at, "left_anti").select(*columns(docs))

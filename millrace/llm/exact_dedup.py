"""Exact deduplication by a stateful stream (DataFrame and SQL functions only).

1. An arrival log (digest, document id, content locator: file and row in it) is consumed by Structured
   Streaming.  The keyed state lives in RocksDB on disk, has no watermark and therefore never expires:
   for every digest it keeps the smallest document id, the locator of its content and the number of
   arrivals.  Given a folder of its own, it goes on where the last call left it, so a delivery is
   deduplicated against all deliveries before.
2. Every hit is checked on its full bytes: the texts of arrivals with a repeated digest, and of the
   kept content that an earlier delivery holds, are read by their locators; within one digest the
   smallest and the largest text must be the same string.  Should a digest ever collide, its rows are
   grouped again by the full text.

Locators need a file: a DataFrame that is not a scan of files is written to the shared folder first.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space.

Defined results: null text is the empty text; all empty texts are one group; a null id is larger
than every id, so it only stays when the whole group has null ids; rows that repeat an id and its
text are reported row by row and share ``kept``; an empty table gives an empty result; other
columns are ignored by :func:`exact_groups`, carried by :func:`drop_exact_copies`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, scratch, stored

_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Else every partition's store sets 4 MB of disk aside for its manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Else stores stay open in the executors after the stream has ended, each with memory of its own.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
#: A Bloom filter over the hits' locators (8 MB at most) keeps other texts out of the shuffle.
_BLOOM_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "67108864",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row) of a scan of files; any other DataFrame is written first."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *place)
    except AnalysisException:
        return stored(narrow, "dedup-texts").select("doc_id", "text", *place)


def arrival_log(located: DataFrame, path: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Write digest, id and content locator of every row to ``path``."""
    text = normalised(F.col("text"))
    located.select(
        "doc_id",
        digest(text).alias("digest"),
        F.struct("file", "row").alias("locator"),
        *([] if digest is sha256 else [sha256(text).alias("sha")]),
    ).write.parquet(path)


def streamed_state(spark: SparkSession, schema, work: str, files_per_batch: int | None = None) -> DataFrame:
    """Feed what is new in the log under ``work`` through the keyed state; returns, for every digest that ever came,
    digest, keep_id, its locator and group_size."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "locator")
    with _settings(spark, _STATE_STORE):
        state = reader.parquet(f"{work}/log/*").groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))

        def commit(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{work}/updates/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start()
        query.awaitTermination()
    try:
        updates = spark.read.parquet(f"{work}/updates")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        empty = "digest binary, keep_id long, locator struct<file string, row long>, group_size long"  # nothing ever arrived
        return spark.createDataFrame([], empty)
    # Of the states a digest went through, the last one has the smallest id and the largest count.
    several = updates.agg(F.min("batch") < F.max("batch")).first()[0]
    last = updates.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size")) if several else updates
    return last.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("locator"), "group_size")


def _texts_at(located: DataFrame, hits: DataFrame) -> DataFrame:
    """(digest, doc_id, text) of the ``hits`` (place, file, row, digest, doc_id, group_size), read by their locators."""
    spark = located.sparkSession
    here = located.select("file").distinct()
    earlier = [r.file for r in hits.select("file").distinct().join(here, "file", "left_anti").collect()]  # files of earlier deliveries
    texts = located.select("text", "file", "row")
    if earlier:
        texts = texts.union(spark.read.parquet(*earlier).select("text", "_metadata.file_path", "_metadata.row_index"))
    wanted = hits.where("group_size > 1").select("place", "digest", "doc_id", F.col("file").alias("_file"), F.col("row").alias("_row"))
    placed = texts.select("*", F.xxhash64("file", "row").alias("_place"))
    same = (F.col("place") == F.col("_place")) & (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row"))
    return placed.join(wanted, same).select("digest", "doc_id", normalised(F.col("text")).alias("text"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``digest`` may be replaced by a weaker one; full-byte checks keep the result right.  ``state``: a shared folder
    that keeps log and state between calls; groups then reach over all deliveries so far.
    """
    spark, located = docs.sparkSession, _located(docs)
    work = state or scratch(spark, "dedup-state")
    mine = scratch(spark, "delivery").rsplit("/", 1)[1]
    arrival_log(located, f"{work}/log/{mine}", digest)
    log = spark.read.parquet(f"{work}/log/{mine}")
    seen = streamed_state(spark, log.schema, work, files_per_batch)
    repeated = seen.where("group_size > 1").select("digest", "keep_id", "locator", "group_size")
    place = [F.xxhash64("locator.file", "locator.row").alias("place"), "locator.file", "locator.row", "digest", "doc_id", "group_size"]
    arrived = log.join(repeated.select("digest", "keep_id", "group_size"), "digest")
    kept = repeated.join(arrived.select("digest").distinct(), "digest", "left_semi").withColumnRenamed("keep_id", "doc_id")
    hits = stored(arrived.select(*place).union(kept.select(*place)).distinct(), "dedup-hits")
    found = _texts_at(located, hits)
    with _settings(spark, _BLOOM_FILTER):
        collided = stored(found.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same")).where(~F.col("same")).select("digest"), "dedup-collided")
    sha = "digest" if digest is sha256 else "sha"
    out = log.join(repeated.select("digest", "keep_id", "group_size"), "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col(sha).alias("sha"),
        "digest",
        "locator",
    )
    if not collided.isEmpty():
        exact = stored(found.join(collided, "digest").select("digest", "doc_id", sha256(F.col("text")).alias("sha")), "dedup-exact")
        groups = exact.groupBy("digest", "sha").agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        again = out.join(groups.withColumnRenamed("digest", "_digest").withColumnRenamed("sha", "_sha"), (F.col("digest") == F.col("_digest")) & (F.col("sha") == F.col("_sha")), "left")
        out = again.withColumns({"keep_id": F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("keep_id")), "group_size": F.coalesce("_size", "group_size")})
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id stays in its group, with all their columns."""
    stay = exact_groups(docs, **options).where("kept").select(F.col("doc_id").alias("_stay"), "text_sha256").distinct()
    here = sha256(normalised(docs["text"]))
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["_stay"]) & (F.lower(F.hex(here)) == stay["text_sha256"]), "left_semi")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

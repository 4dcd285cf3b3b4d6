"""A store of documents as chunks, in buckets by document, changed by numbered commits.

A document is all chunks of one source; a chunk without a source is a document of its own.  The store holds

* ``chunks`` (id, source, chunk_index, content[, embedding]) in buckets by a hash of the document's key,
* ``documents`` (source, chunk counts by key) in the same buckets, so that counts and listings read no contents,
* ``ids`` (chunk id, document key) in buckets by a hash of the id, so that an id finds its document without a scan.

Every change is a batch with a number.  It writes new files and, last, a marker that lists the files which make up each
bucket from then on, with the totals of the whole store; what has no marker is never read.  A batch that is committed
already changes nothing and gives its report again, so retried jobs add nothing.  Appending writes new files only; an
update or a deletion reads and rewrites the buckets of the documents it touches, and no others.  Contents that stay or
are cut again are picked out where they are read, by keys that are broadcast for as many buckets at once as have
``BROADCAST_KEYS`` of them (a bucket that has more alone is joined by shuffle); only new chunks are dealt out.

``buckets`` is fixed when the store is made: a few times the cores of the cluster, or more for a very large store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import UUID_PATTERN, source_label, strip
from ..scratch import folder, stored
from ..sources.ingest import to_chunks
from .buckets import Buckets, State
from .documents import rechunk

SCHEMAS = {"chunks": "id string, source string, chunk_index int, content string", "documents": "doc_key string, source string, chunk_count bigint", "ids": "id string, doc_key string"}
#: Keys that are broadcast at once.
BROADCAST_KEYS = 200_000
TOTALS = ("documents", "chunks", "sources")
UPDATED, DELETED, MISSING, BLANK, SUPERSEDED = "updated", "deleted", "missing", "blank", "superseded"


def doc_key() -> Column:
    return F.coalesce(F.nullif("source", F.lit("")), F.col("id"))


class DocumentStore(Buckets):
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, embedder: Callable[[DataFrame], DataFrame] | None = None, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap):
        """``embedder`` adds ``embedding`` to rows with ``content``; only new chunks are embedded."""
        super().__init__(spark, path, buckets, SCHEMAS | ({"chunks": SCHEMAS["chunks"] + ", embedding array<float>"} if embedder else {}))
        self.embedder, self.cut = embedder, {"size": size, "overlap": overlap}

    # Reading

    def chunks(self) -> DataFrame:
        return self.table(self.state(), "chunks")

    def documents(self) -> DataFrame:
        """(doc_key, source, chunk_count) of all documents, without their contents."""
        return self.table(self.state(), "documents").groupBy("doc_key", "source").agg(F.sum("chunk_count").alias("chunk_count"))

    def listing(self) -> DataFrame:
        """(doc_key, label, chunk_count, caption)."""
        n = F.col("chunk_count")
        return self.documents().select("doc_key", source_label(F.col("source")).alias("label"), n, F.concat(n.cast("string"), F.when(n == 1, " chunk").otherwise(" chunks")).alias("caption"))

    def dashboard(self) -> DataFrame:
        """One row (documents, chunks, sources), kept up to date by every change."""
        totals = self.state().totals
        return self.spark.createDataFrame([tuple(totals.get(t, 0) for t in TOTALS)], ", ".join(f"{t} bigint" for t in TOTALS))

    # Writing

    def _finish(self, batch: int, state: State, report: DataFrame | None) -> None:
        if report is not None:
            report.write.mode("overwrite").parquet(f"{self.path}/reports/batch={batch}")
        self.commit(batch, state)

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        plain = chunks.select("id", "source", "chunk_index", "content")
        return self.embedder(plain) if self.embedder else plain

    def _counted(self, chunks: DataFrame) -> DataFrame:
        return chunks.groupBy(doc_key().alias("doc_key"), F.nullif("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("chunk_count"))

    @staticmethod
    def _summed(documents: DataFrame) -> dict[str, int]:
        whole = documents.groupBy("doc_key", "source").agg(F.sum("chunk_count").alias("n"))
        r = whole.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("source").alias("sources")).first()
        return {t: r[t] for t in TOTALS}

    def append(self, batch: int, raw: DataFrame, check: Callable[[DataFrame], None] | None = None) -> None:
        """Add documents (doc_id, source, content); those of a known source join its chunks."""
        self.append_chunks(batch, to_chunks(raw, **self.cut), check)

    def append_chunks(self, batch: int, chunks: DataFrame, check: Callable[[DataFrame], None] | None = None) -> None:
        """Add chunks (id, source, chunk_index, content); ``check`` may stop the batch after a look at what was written."""
        state = self.begun(batch)
        if state is not None:
            written, buckets = self.write("chunks", self._embedded(chunks).withColumn("_key", doc_key()), "_key", batch, ["id"])
            if check is not None:
                check(written)
            self._finish(batch, self._grown(batch, state, written, buckets), None)

    def _grown(self, batch: int, state: State, written: DataFrame, buckets: list[int], rewritten: list[int] | None = None) -> State:
        """``state`` after the chunks ``written`` came to ``buckets``; those of ``rewritten`` hold nothing else."""
        before = self._summed(self.table(state, "documents", buckets if rewritten is None else rewritten))
        fresh, filled = self.write("documents", self._counted(written), "doc_key", batch, ["doc_key"])
        self.replace(state, "chunks", rewritten or [], batch, buckets)
        self.replace(state, "documents", rewritten or [], batch, filled)
        after = self._summed(self.table(state, "documents", buckets if rewritten is None else rewritten))
        state.totals = {t: state.totals.get(t, 0) + after[t] - before[t] for t in TOTALS}
        known = written.select("id", doc_key().alias("doc_key"))
        _, homes = self.write("ids", known, "id", batch, ["id"])
        self.replace(state, "ids", [], batch, homes)
        return state

    # Changes by key

    def _resolved(self, state: State, keys: DataFrame) -> DataFrame:
        """(key, doc_key) of keys that are chunk ids or sources; an id finds its whole document, and goes before a source."""
        keys = keys.select("key").where("key is not null").distinct()
        uuids = keys.where(F.col("key").rlike(UUID_PATTERN)).select("key", F.lower("key").alias("id"))
        homes = sorted({r.b for r in uuids.select(self.bucket("id").alias("b")).distinct().toLocalIterator()})
        claimed = stored(uuids.join(self.table(state, "ids", homes), "id").distinct(), "claimed")
        there = self.table(state, "chunks", self.buckets_of("doc_key", claimed)).select("id", doc_key().alias("doc_key"))  # entries of ids may be of chunks that are gone
        by_id = claimed.join(there, ["id", "doc_key"], "left_semi").select("key", "doc_key")
        rest = keys.join(by_id.select("key"), "key", "left_anti")
        named = self.table(state, "documents", self.buckets_of("doc_key", rest.select(F.col("key").alias("doc_key")))).where("source is not null").select("doc_key").distinct()
        return stored(by_id.unionByName(rest.join(named, rest["key"] == named["doc_key"])), "resolved")

    def delete(self, batch: int, keys: DataFrame) -> DataFrame:
        """Remove the documents of ``keys`` (key: a chunk id or a source).  The report: (key, status, chunks)."""
        state = self.begun(batch)
        if state is not None:
            found = self._resolved(state, keys)  # stored
            touched = self.buckets_of("doc_key", found)
            counts = self.table(state, "documents", touched).groupBy("doc_key").agg(F.sum("chunk_count").alias("chunks"))
            told = keys.select("key").distinct().join(found, "key", "left").join(counts, "doc_key", "left")
            report = told.select("key", F.when(F.col("doc_key").isNull(), MISSING).otherwise(DELETED).alias("status"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
            self._rewrite(batch, state, found, None, report, touched)
        return self._report(batch)

    def update(self, batch: int, changes: DataFrame) -> DataFrame:
        """Cut documents again after ``changes`` (key, content, source[, seq]).  The report: (key, status, chunks).

        Without content the document's own chunks are joined and cut again; blank content is refused and changes nothing.
        Without a source the document keeps its own.  Of several changes to one document the last by ``seq`` counts.
        """
        state = self.begun(batch)
        if state is not None:
            seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
            asked = changes.select("key", "content", F.nullif("source", F.lit("")).alias("new_source"), seq.cast("long").alias("seq"))
            found = asked.join(self._resolved(state, asked), "key", "left")
            last = Window.partitionBy("doc_key").orderBy(F.desc("seq"), "key", "content")
            ranked = found.withColumn("nth", F.when(F.col("doc_key").isNotNull(), F.row_number().over(last))).withColumn("clean", strip(F.col("content")))
            status = F.when(F.col("doc_key").isNull(), MISSING).when(F.col("nth") > 1, SUPERSEDED).when(F.col("clean") == "", BLANK).otherwise(UPDATED)
            marked = stored(ranked.select("key", "doc_key", "new_source", status.alias("status"), F.col("content").isNotNull().alias("given"), F.when(status == UPDATED, F.col("clean")).alias("content")), "changes", "zstd")
            good = marked.where(F.col("status") == UPDATED)
            touched = self.buckets_of("doc_key", good)
            sources = self.table(state, "documents", touched).select("doc_key", "source").distinct()
            given = good.where("given").join(sources, "doc_key").select(F.col("doc_key").alias("doc_id"), F.coalesce("new_source", "source").alias("source"), "content")
            again = self._picked(state, good.where("not given").select("doc_key", "new_source")).withColumn("source", F.coalesce("new_source", F.nullif("source", F.lit(""))))
            made = stored(to_chunks(given, **self.cut).unionByName(rechunk(again, key="doc_key", named_by=F.col("doc_id"), **self.cut)), "made", "zstd").withColumnRenamed("doc_id", "_from")
            fresh = stored(self._embedded(made).join(made.select("id", "_from"), "id"), "fresh", "zstd") if self.embedder else made
            counts = fresh.groupBy(F.col("_from").alias("doc_key")).agg(F.count(F.lit(1)).alias("chunks"))
            # a document whose chunks hold nothing but white space stays as it is
            hollow = good.where("not given").join(counts, "doc_key", "left_anti").select("key")
            told = marked.join(hollow.withColumn("hollow", F.lit(True)), "key", "left").withColumn("status", F.when(F.col("hollow") & (F.col("status") == UPDATED), BLANK).otherwise(F.col("status")))
            report = told.join(counts, "doc_key", "left").select("key", "status", F.when(F.col("status") == UPDATED, F.coalesce("chunks", F.lit(0))).otherwise(0).cast("long").alias("chunks"))
            gone = stored(good.join(counts, "doc_key", "left_semi").select("doc_key").distinct(), "gone")
            self._rewrite(batch, state, gone, fresh.drop("_from"), report, None)
        return self._report(batch)

    def _groups(self, keys: DataFrame, buckets: list[int]) -> list[tuple[list[int], DataFrame]]:
        """``buckets`` in groups, each with its rows of ``keys`` (doc_key, ...), to be broadcast but for those of a bucket that has too many."""
        counts = {r.b: r["count"] for r in keys.groupBy(self.bucket("doc_key").alias("b")).count().toLocalIterator()}  # a row for each bucket
        groups: list[tuple[list[int], int]] = []
        for b in buckets:
            n = counts.get(b, 0)
            if groups and groups[-1][1] + n <= BROADCAST_KEYS:
                groups[-1] = ([*groups[-1][0], b], groups[-1][1] + n)
            else:
                groups.append(([b], n))
        return [(group, F.broadcast(part) if n <= BROADCAST_KEYS else part) for group, n in groups for part in [keys.where(self.bucket("doc_key").isin(group))]]

    def _picked(self, state: State, keys: DataFrame) -> DataFrame:
        """The chunks of the documents of ``keys`` (doc_key, new_source), with the columns of both, written apart."""
        path, columns = folder(self.spark, "picked"), "id string, source string, chunk_index int, content string"
        for group, part in self._groups(keys, self.buckets_of("doc_key", keys)):
            there = self.table(state, "chunks", group).select("id", "source", "chunk_index", "content").withColumn("doc_key", doc_key())
            there.join(part, "doc_key").write.mode("append").option("compression", "zstd").parquet(path)
        self.spark.createDataFrame([], f"doc_key string, {columns}, new_source string").write.mode("append").parquet(path)
        return self.spark.read.schema(f"doc_key string, {columns}, new_source string").parquet(path)

    def _rewrite(self, batch: int, state: State, gone: DataFrame, fresh: DataFrame | None, report: DataFrame, touched: list[int] | None) -> None:
        if touched is None:
            touched = self.buckets_of("doc_key", gone, fresh.select(doc_key().alias("doc_key")))
        report = stored(report, "report")
        if touched:
            if fresh is not None:
                self.write("chunks", fresh.withColumn("_key", doc_key()), "_key", batch, ["id"])
            for n, (group, part) in enumerate(self._groups(gone.select("doc_key"), touched)):
                kept = self.table(state, "chunks", group).withColumn("_key", doc_key()).join(part.withColumnRenamed("doc_key", "_key"), "_key", "left_anti")
                self.keep("chunks", kept, "_key", batch, more=n > 0 or fresh is not None)
            state = self._grown(batch, state, *self.written("chunks", batch), touched)
        self._finish(batch, state, report)

    def _report(self, batch: int) -> DataFrame:
        return self.spark.read.schema("key string, status string, chunks bigint").parquet(f"{self.path}/reports/batch={batch}")

    def compact(self, batch: int) -> None:
        """Join the files of every bucket, and forget the ids of chunks that are gone."""
        state = self.begun(batch)
        if state is not None:
            for key in [k for k in state.files if k[0] == "ids"]:
                del state.files[key]
            written, buckets = self.write("chunks", self.chunks().withColumn("_key", doc_key()), "_key", batch, ["id"])
            report = self.spark.createDataFrame([], "key string, status string, chunks bigint")
            self._finish(batch, self._grown(batch, state, written, buckets, list(range(self.buckets))), report)

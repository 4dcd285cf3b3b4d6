"""Continuous ingest: arriving files are admitted, named, read, cut, embedded and stored, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..operators.buckets import Buckets
from ..operators.documents import vector_violations
from ..operators.running import numbered
from ..operators.store import DocumentStore
from ..scratch import stored
from ..sources.ingest import admit, route_by_type
from ..sources.naming import rename_collisions, root_of

FILES = "path string, modificationTime timestamp, length bigint, content binary"


class StoredNames(Buckets):
    """All names given so far, in buckets by the name that they derive from, so that a batch reads those it may meet only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, buckets, {"names": "root string, name string"})

    def named(self, batch: int, files: DataFrame) -> DataFrame:
        """(arrival, path, name, stored_name) of (arrival, path, name): as they were named, if ``batch`` was named before."""
        state, given = self.begun(batch), f"{self.path}/given/batch={batch}"
        if state is not None:
            wanted = files.withColumn("root", root_of("name"))
            near = self.table(state, "names", self.buckets_of("root", wanted)).join(wanted.select("root").distinct(), "root", "left_semi")
            rename_collisions(files, near.select("name")).write.mode("overwrite").parquet(given)
            names = self.spark.read.schema("arrival bigint, path string, name string, stored_name string").parquet(given)
            _, filled = self.write("names", names.select(root_of("stored_name").alias("root"), F.col("stored_name").alias("name")), "root", batch, ["name"])
            self.replace(state, "names", [], batch, filled)
            self.commit(batch, state)
        return self.spark.read.schema("arrival bigint, path string, name string, stored_name string").parquet(given)


def ingest_batch(batch: int, files: DataFrame, extractors: dict[str, Callable], names: StoredNames, store: DocumentStore, rejected: str) -> None:
    """Files (path, modificationTime, content) as one numbered batch of ``store``; those of other types go to ``rejected``.

    Files arrive in the order of their times, then their paths.  A batch that runs again gets the names it had, and adds
    nothing that is there.  Chunks without a vector, or with one of a wrong length, stop it before anything is stored.
    """
    slim = numbered(admit(files.select("path", "modificationTime")).where("admitted"), [], ["modificationTime", "path"], "arrival")
    named = names.named(batch, slim.select("arrival", "path", "name"))
    texts, others = route_by_type(files.select("path", "content"), extractors)
    others.select("path").write.mode("overwrite").parquet(f"{rejected}/batch={batch}")
    raw = texts.join(named.select("path", "stored_name"), "path").select(F.xxhash64("stored_name").alias("doc_id"), F.col("stored_name").alias("source"), "content")
    store.append(batch, stored(raw, "arrived"), checked)


def checked(chunks: DataFrame, dimension: int = SETTINGS.dimension) -> None:
    if "embedding" in chunks.columns and not vector_violations(chunks, dimension).isEmpty():
        raise ValueError(f"{vector_violations(chunks, dimension).count()} chunks have no vector of length {dimension}")


def ingest_stream(spark: SparkSession, folder: str, store: DocumentStore, extractors: dict[str, Callable], path: str, files_per_batch: int = 10_000) -> None:
    """Files that have arrived in ``folder`` since the last call, in batches; ``path`` keeps the stream's place and names."""
    names = StoredNames(spark, f"{path}/names", store.buckets)
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        ingest_batch(number, df, extractors, names, store, f"{path}/rejected")

    files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

"""Reading tables, scratch folders and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string): every other column, whatever its name, is left behind; null text is empty."""
    return docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name that driver and executors share, under spark.checkpoint.dir.

    Where that is unset a local session takes a folder of its own for it; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/millrace-{spark.sparkContext.applicationId}"
    return f"{root}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let Spark remove the shuffles that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Remove ``stored`` tables that no later step reads, and the shuffles they came from."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
        freed(df.sparkSession)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside; the session's own setting comes back after them.

    Spark and the Python worker each hold a batch of whole texts or sets more than once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod ``modulus``, equals ``remainder`` (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def record(columns: dict[str, np.ndarray | list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, field.type) for x, field in zip(columns.values(), schema, strict=True)], schema=schema)


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

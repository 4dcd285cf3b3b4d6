"""Sources and sinks: files, parts, tables, JDBC; admission, collisions of names; chunked ingest."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS, SETTINGS
from ..functions.text import basename, extension, normalise_space, strip, uuid_of, windows
from .naming import rename_collisions


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of UTF-8 files; bytes that do not decode are dropped.  Valid files stay in the JVM."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    valid = files.where(F.is_valid_utf8("content")).select("path", F.decode("content", "UTF-8").alias("content"))
    return valid.unionByName(files.where(~F.is_valid_utf8("content")).mapInArrow(utf8_text, "path string, content string"))


def utf8_text(batches):
    """An extractor of (path, content: bytes): UTF-8, bytes that do not decode dropped."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([b.decode("utf-8", "ignore") for b in batch.column("content").to_pylist()], pa.string())], names=["path", "content"])


def read_whole_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row per file, strict: (accepted: path, content), (rejected: path, reason)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.is_valid_utf8("content").alias("ok"))
    return files.where("ok").select("path", F.decode("content", "UTF-8").alias("content")), files.where("not ok").select("path", F.lit("not UTF-8").alias("reason"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def assemble_parts(parts: DataFrame) -> DataFrame:
    """(file, content) from (file, part_no, text): parts in order, null as empty, joined by line feeds."""
    return parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p")).select("file", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("content"))


def admit(files: DataFrame) -> DataFrame:
    """Adds name, ext and admitted to rows with a path: named, and of a known type."""
    return files.withColumn("name", basename(F.coalesce("path", F.lit("")))).withColumn("ext", extension(F.col("name"))).withColumn("admitted", (F.col("name") != "") & F.col("ext").isin(*EXTENSIONS))


def route_by_type(files: DataFrame, extractors: dict[str, Callable]) -> tuple[DataFrame, DataFrame]:
    """(path, content) through the extractor of each type (a function of Arrow batches), and the rejected rows."""
    marked = admit(files)
    out = None
    for ext, extract in extractors.items():
        part = marked.where(F.col("admitted") & (F.col("ext") == ext)).select("path", "content").mapInArrow(extract, "path string, content string")
        out = part if out is None else out.unionByName(part)
    return out, marked.where(~F.col("admitted") | ~F.col("ext").isin(*extractors))


def to_chunks(raw: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """(id, source, chunk_index, content, doc_id) from (doc_id, source, content)."""
    clean = raw.select("doc_id", "source", normalise_space(F.coalesce("content", F.lit(""))).alias("clean"))
    exploded = clean.select("doc_id", "source", F.posexplode(windows(F.col("clean"), size, overlap)).alias("chunk_index", "content"))
    return exploded.select(uuid_of(F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.col("content")).alias("id"), "source", "chunk_index", "content", "doc_id")


def append(chunked: DataFrame, path: str) -> None:
    chunked.write.mode("append").parquet(path)


def embed_folder(spark: SparkSession, path: str, embedder: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(one row for each file, whole: id, source, chunk_index, content, embedding; rejected: path, reason), to be appended.

    Rows have no source and no index, as files ingested whole have none.
    """
    good, bad = read_whole_folder(spark, path)
    rows = good.select(uuid_of(F.col("path"), F.col("content")).alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("chunk_index"), "content")
    return embedder(rows), bad


def ingest_report(chunked: DataFrame) -> DataFrame:
    return chunked.agg(F.countDistinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"))


def with_source(raw: DataFrame) -> DataFrame:
    """New documents (doc_id, source, content): content stripped, blank ones gone, a missing source named after its row."""
    text = raw.withColumn("content", strip(F.coalesce("content", F.lit("")))).where("content <> ''")
    named = F.coalesce(F.nullif(strip(F.col("source")), F.lit("")), F.concat(F.lit("manual-"), uuid_of(F.col("doc_id").cast("string"), F.col("content"))))
    return text.withColumn("source", named)


def build_index(df: DataFrame, key: str, text: str, metadata: str | None = None, embedder: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """(id, content, metadata[, embedding]) rows of a generic store; missing metadata is the empty map.

    Every row of ``df`` gets an id of its own, from its ``key`` and text; ``embedder`` gives (id, embedding) rows.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = df.select(uuid_of(F.col(key).cast("string"), F.col(text)).alias("id"), F.col(text).alias("content"), (F.coalesce(F.col(metadata), empty) if metadata else empty).alias("metadata"))
    return rows if embedder is None else embedder(rows, "id", "content")

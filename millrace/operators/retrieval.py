"""Nearest neighbours: hashed term vectors as postings, dense vectors in blocks; context assembly."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NO_CONTEXT, SETTINGS
from ..functions.text import strip
from ..functions.vectors import term_counts, with_features
from ..scratch import stored

#: Query vectors held by a task at once.
BLOCK_VECTORS = 2048


def blocks(df: DataFrame, key: str, rows: int, most: int) -> list[DataFrame]:
    """``df`` in parts of about ``most`` rows, split by hash of the key; one part if ``rows`` is no more."""
    n = max(1, -(-rows // most))
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def hashed_vectors(chunked: DataFrame, dimension: int = SETTINGS.dimension, rows: int = 512) -> DataFrame:
    """(id, source, chunk_index, counts): hashed term vectors (MD5) as 32-bit counts, made once for any number of searches."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                counts = term_counts(part.column("features"), dimension, "md5").astype("<i4")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "source", "chunk_index")), pa.array([x.tobytes() for x in counts], pa.binary())], names=["id", "source", "chunk_index", "counts"])

    listed = with_features(chunked.select("id", "source", "chunk_index", "content"), "content", "features").drop("content")
    return listed.mapInArrow(run, "id string, source string, chunk_index int, counts binary")


def vectors_of(queries: DataFrame, dimension: int) -> tuple[list[int], np.ndarray]:
    """The ids and vectors of one block of queries (query_id, query)."""
    asked = queries.select("query_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("chunk_index"), F.col("query").alias("content"))
    rows = hashed_vectors(asked.withColumn("id", F.col("query_id").cast("string")), dimension).collect()
    return [int(r.id) for r in rows], np.array([np.frombuffer(r.counts, "<i4") for r in rows], dtype=float).reshape(len(rows), dimension)


HITS = pa.schema([("query_id", pa.int64()), ("distance", pa.float64()), ("id", pa.string()), ("source", pa.string()), ("chunk_index", pa.int32())])
HIT_ROWS = "query_id long, distance double, id string, source string, chunk_index int"


def nearest_rows(names: list[int], table: np.ndarray, wide: np.ndarray, chunks: tuple[list, list, list], k: int, meeting: bool = False, asked: np.ndarray | None = None) -> pa.RecordBatch:
    """The k nearest of the chunks (ids, sources, places) with vectors ``wide`` to each query, as rows of ``HITS``.

    With ``meeting`` only pairs that share a bucket count, with ``asked`` only those it is true of.
    """
    n, (ids, sources, places) = min(k, len(wide)) - 1, chunks
    with np.errstate(divide="ignore", invalid="ignore"):  # whole numbers, exact in doubles
        distance = 1 - (table @ wide.T) / (np.sqrt((table * table).sum(axis=1))[:, None] * np.sqrt((wide * wide).sum(axis=1))[None, :])
    order = np.where(np.isnan(distance), np.inf, distance)
    if asked is not None:
        order[~asked] = np.inf
    cut = np.partition(order, n, axis=1)[:, n]
    if meeting:  # a pair that shares none has a distance of 1
        far = np.flatnonzero(cut >= 1)
        order[far] = np.where((table[far] != 0).astype(np.float32) @ (wide != 0).astype(np.float32).T > 0, order[far], np.inf)
        cut[far] = np.partition(order[far], n, axis=1)[:, n]
    some, out = meeting or asked is not None, []
    for q, (name, limit) in enumerate(zip(names, cut, strict=True)):
        close = order[q] <= limit
        near = [(order[q, i], sources[i] is None, sources[i] or "", places[i] is None, places[i] or 0, ids[i], i) for i in np.flatnonzero(close & np.isfinite(order[q]) if some else close)]
        out += [(name, float(distance[q, x[-1]]), x[-2], sources[x[-1]], places[x[-1]]) for x in sorted(near)[:k]]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(HITS)], schema=HITS)


def hashed_topk(queries: DataFrame, chunked: DataFrame, k: int = SETTINGS.top_k, dimension: int = SETTINGS.dimension, meeting: bool = False) -> DataFrame:
    """(query_id, rank, distance, id, source, chunk_index): cosine distance of hashed term vectors, ties by source, index and id.

    Queries are (query_id, query), chunks (id, source, chunk_index, content) or the rows of
    ``hashed_vectors``.  Vectors of chunks never shuffle: blocks of at most ``BLOCK_VECTORS`` query
    vectors travel with the tasks and each slice of a batch passes on its best k per query.  Texts are
    read once; with several blocks their vectors are written and read again.  A chunk without terms has
    distance NaN, which sorts last; with ``meeting`` only chunks that share a bucket with a query have rows.
    """
    vectors = chunked if "counts" in chunked.columns else hashed_vectors(chunked, dimension)
    split, parts = blocks(queries, "query_id", queries.count(), BLOCK_VECTORS), []
    if len(split) > 1 and vectors is not chunked:
        vectors = stored(vectors, "hashed-vectors")
    for part in split:
        names, table = vectors_of(part, dimension)
        if not names:
            continue

        def search(batches, names=names, table=table):
            for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
                wide = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4").reshape(batch.num_rows, dimension).astype(float)
                yield nearest_rows(names, table, wide, tuple(batch.column(c).to_pylist() for c in ("id", "source", "chunk_index")), k, meeting)

        parts.append(vectors.mapInArrow(search, HIT_ROWS))
    if not parts:
        return chunked.sparkSession.createDataFrame([], "query_id long, rank int, distance double, id string, source string, chunk_index int")
    return _ranked(reduce(DataFrame.unionByName, parts), k)


def postings_topk(queries: DataFrame, chunked: DataFrame, k: int = SETTINGS.top_k, dimension: int = SETTINGS.dimension) -> DataFrame:
    """The same over the buckets that both sides have; chunks that share no bucket with a query have no row.

    Postings meet where a chunk is read, so neither they nor the pairs of query and chunk are ever rows.
    """
    return hashed_topk(queries, chunked, k, dimension, meeting=True)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", F.col("source").asc_nulls_last(), F.col("chunk_index").asc_nulls_last(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "distance", "id", "source", "chunk_index")


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, distance, rank) by exact distances, ties by id; both sides are (vec_id, embedding).

    The base is read once for each block of at most ``BLOCK_VECTORS`` query vectors, which travel with the tasks, and
    never shuffled; a matrix product gives each batch's distances and its best k go on.  For many queries, or a base
    that is searched again, :mod:`.neighbours` has an index that rules most of it out.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])
    parts = []
    for part in blocks(queries, "vec_id", queries.count(), BLOCK_VECTORS):
        rows = part.where("embedding is not null").select("vec_id", "embedding").collect()  # one block of queries
        if not rows:
            continue
        names, matrix = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)

        def search(batches, names=names, matrix=matrix):
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                for batch in batches:
                    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                    if not len(ids):
                        continue
                    here = np.array(batch.column("embedding").to_pylist(), dtype=float)
                    if metric == "cosine":
                        distance = 1 - unit @ (here / np.linalg.norm(here, axis=1, keepdims=True)).T
                    else:
                        distance = np.sqrt(np.maximum(((matrix[:, None, :] - here[None, :, :]) ** 2).sum(axis=2), 0)) if matrix.size * len(here) <= 5e7 else np.stack([np.sqrt(((m - here) ** 2).sum(axis=1)) for m in matrix])
                    rounded = np.round(distance, 9)
                    best = np.stack([np.lexsort((ids, row))[:k] for row in rounded])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(rounded, best, axis=1).ravel())], schema=schema)

        sized = base.where(F.size("embedding") == matrix.shape[1]).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        parts.append(sized.mapInArrow(search, "query_id long, vec_id long, distance double"))
    if not parts:
        return base.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context(queries: DataFrame, hits: DataFrame, chunked: DataFrame) -> DataFrame:
    """(query_id, query, context, sources): headed blocks in rank order; without hits the fixed sentence and no sources."""
    texts = hits.join(chunked.select("id", "content"), "id")
    header = F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("None")), F.lit(" | Chunk: "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("None")), F.lit("]\n"), strip(F.col("content")))
    rows = texts.select("query_id", F.struct("rank", header.alias("block"), "content", "id", "source", "chunk_index").alias("r"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("r"))  # at most k rows
    joined = queries.join(listed, "query_id", "left")
    sources = F.transform("r", lambda x: F.struct(x["content"].alias("content"), x["id"].alias("id"), x["source"].alias("source"), x["chunk_index"].alias("chunk_index")))
    return joined.select("query_id", "query", F.coalesce(F.array_join(F.transform("r", lambda x: x["block"]), "\n\n---\n\n"), F.lit(NO_CONTEXT)).alias("context"), F.coalesce(sources, F.array().cast("array<struct<content:string,id:string,source:string,chunk_index:int>>")).alias("sources"))

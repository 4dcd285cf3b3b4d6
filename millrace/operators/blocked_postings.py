"""Exact top-k over stored vectors of hashed terms in blocks, with upper bounds that rule blocks of chunks out.

The index puts chunks side by side that are alike (by two minima of hashes over a chunk's postings, which chunks share as
often as they are alike) and cuts them into blocks of ``block_rows``.  A row of ``lists`` is one block: its chunks, their
packed vectors, and for each bucket the least and largest impact (weight by length of the vector) among them, rounded away
from zero to 16 bits.  Vectors are packed where a text is read, so no row is ever a single posting.

A search sums, for each query and block, what the impacts allow at most, from the impacts alone.  The blocks of the highest
bounds are scored first; the k-th distance found there rules out all blocks that cannot reach it, whose vectors are then
not unpacked.  Each batch of blocks passes on its best k, so neither bounds nor pairs of query and chunk are written.

Defined results: those of ``hashed_topk`` but that a chunk without a common bucket has no row; ids are unique; a query or chunk
without terms, or an empty table on either side, gives no rows; ties go by source, index and id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.vectors import term_counts, with_features
from ..scratch import stored
from .retrieval import BLOCK_VECTORS, HIT_ROWS, _ranked, blocks, nearest_rows, vectors_of

#: What sums of doubles may be wrong by; the steps of an impact; blocks that are scored at once.
SLACK, STEPS, SLICE = 1e-9, 65535, 64


@dataclass
class PostingsIndex:
    """``lists``: (block, impacts, ids, sources, places, vectors); impacts are the least and then the largest by bucket."""

    lists: DataFrame
    dimension: int


def pack(counts: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, compressed."""
    most = int(np.abs(counts).max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s - 1)
    squeeze = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return bytes([size]) + squeeze.compress(counts.astype(f"<i{size}").tobytes()) + squeeze.flush()


def unpack(packed: bytes, dimension: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"<i{packed[0]}").reshape(-1, dimension)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(chunked: DataFrame, dimension: int, rows: int = 256) -> DataFrame:
    """(a, b, id, source, chunk_index, vector) of the chunks with terms; a and b are alike where the vectors are."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.string()), ("source", pa.string()), ("chunk_index", pa.int32()), ("vector", pa.binary())])

    def run(batches):
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            counts = term_counts(batch.column("features"), dimension, "md5").astype(np.int64)
            row, bucket = np.nonzero(counts)
            kept, first = np.unique(row, return_index=True)
            if not len(kept):
                continue
            entry = _mixed((bucket.astype(np.uint64) << np.uint64(32)) + counts[row, bucket].astype(np.uint64))
            alike = [np.minimum.reduceat(x >> np.uint64(1), first).astype(np.int64) for x in (entry, _mixed(entry + np.uint64(0x9E3779B97F4A7C15)))]
            named = (batch.column(c).take(pa.array(kept)) for c in ("id", "source", "chunk_index"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, alike), *named, pa.array([pack(counts[i]) for i in kept], pa.binary())], schema=schema)

    listed = with_features(chunked.select("id", "source", "chunk_index", "content"), "content", "features").drop("content")
    return listed.mapInArrow(run, "a long, b long, id string, source string, chunk_index int, vector binary")


def index_postings(chunked: DataFrame, dimension: int = SETTINGS.dimension, block_rows: int = 16) -> PostingsIndex:
    """The index of (id, source, chunk_index, content), written once for any number of searches."""
    schema = pa.schema([("block", pa.int64()), ("impacts", pa.binary()), ("ids", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("vectors", pa.binary())])

    def cut(batches):
        n = TaskContext.get().partitionId() << 40
        for part in (b.slice(at, block_rows) for b in batches for at in range(0, b.num_rows, block_rows)):
            counts = np.concatenate([unpack(x, dimension) for x in part.column("vector").to_pylist()]).astype(np.int64)
            impact = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            ends = np.ceil(np.stack([-impact.min(axis=0), impact.max(axis=0)]).clip(0, 1) * STEPS).astype("<u2")  # a bucket that a chunk lacks gives it 0
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([ends.tobytes()]), *(pa.array([part.column(c).to_pylist()], schema.field(f).type) for c, f in (("id", "ids"), ("source", "sources"), ("chunk_index", "places"))), pa.array([pack(counts)])], schema=schema)
            n += 1

    dealt = stored(_packed(chunked, dimension), "postings").repartitionByRange("a", "b", "id").sortWithinPartitions("a", "b", "id").drop("a", "b")
    lists = dealt.mapInArrow(cut, "block long, impacts binary, ids array<string>, sources array<string>, places array<int>, vectors binary")
    return PostingsIndex(stored(lists, "postings-lists"), dimension)


def _bounds(table: np.ndarray, impacts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The most that the cosine of a query with a chunk of a block can be, and whether they share a bucket, by query and block."""
    ends = np.frombuffer(b"".join(impacts), "<u2").reshape(len(impacts), 2, -1)
    least, most = (ends[:, i].astype(float) / STEPS for i in (0, 1))
    bound = (np.maximum(table, 0) @ most.T + np.maximum(-table, 0) @ least.T) / np.sqrt((table * table).sum(axis=1))[:, None]
    return bound, (table != 0).astype(np.float32) @ (ends.any(axis=1)).astype(np.float32).T > 0


def _score(names: list[int], table: np.ndarray, batch: pa.RecordBatch, wanted: np.ndarray, dimension: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of the blocks of ``batch`` that are ``wanted`` (by query and block); others are not unpacked."""
    some, asking = np.flatnonzero(wanted.any(axis=0)), np.flatnonzero(wanted.any(axis=1))
    if len(some):
        vectors = [unpack(batch.column("vectors")[int(i)].as_py(), dimension) for i in some]
        chunks = tuple([x for i in some for x in batch.column(c)[int(i)].as_py()] for c in ("ids", "sources", "places"))
        asked = np.repeat(wanted[np.ix_(asking, some)], [len(v) for v in vectors], axis=1)
        yield nearest_rows([names[q] for q in asking], table[asking], np.concatenate(vectors).astype(float), chunks, k, meeting=True, asked=asked)


def _slices(batches):
    return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))


def _opening(names: list[int], table: np.ndarray, index: PostingsIndex, first: int) -> dict[int, set[int]]:
    """The ``first`` blocks of the highest bounds of each query of one block of queries."""

    def best(batches):
        for batch in _slices(batches):
            bound, shared = _bounds(table, batch.column("impacts").to_pylist())
            bound[~shared] = -1
            top = np.argsort(-bound, axis=1, kind="stable")[:, :first]
            q, at = np.repeat(np.arange(len(names)), top.shape[1]), top.ravel()
            kept = bound[q, at] >= 0
            q, at = q[kept], at[kept]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[q], pa.int64()), batch.column("block").take(pa.array(at)), pa.array(bound[q, at])], names=["query_id", "block", "bound"])

    found = index.lists.select("block", "impacts").mapInArrow(best, "query_id long, block long, bound double")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    out: dict[int, set[int]] = {}
    for r in found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first).collect():  # first rows a query
        out.setdefault(r.query_id, set()).add(r.block)
    return out


def _limits(names: list[int], table: np.ndarray, index: PostingsIndex, k: int, opening: dict[int, set[int]]) -> np.ndarray:
    """The k-th distance that each query finds in its opening blocks, infinite where there are fewer."""
    dimension, wanted = index.dimension, sorted(set().union(*opening.values()))

    def early(batches):
        for batch in _slices(batches):
            at = batch.column("block").to_pylist()
            yield from _score(names, table, batch, np.array([[b in opening.get(n, ()) for b in at] for n in names]), dimension, k)

    there = index.lists.join(F.broadcast(index.lists.sparkSession.createDataFrame([(b,) for b in wanted], "block long")), "block", "left_semi")
    last = {r.query_id: r.distance for r in _ranked(there.mapInArrow(early, HIT_ROWS), k).where(F.col("rank") == k).collect()}  # a row a query
    return np.array([last.get(n, np.inf) for n in names])


def _taken(names: list[int], table: np.ndarray, batch: pa.RecordBatch, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By query and block: whose bound reaches the limit, and which share a bucket."""
    bound, shared = _bounds(table, batch.column("impacts").to_pylist())
    return shared & (1 - bound <= limits[:, None] + SLACK), shared


def _asked(queries: DataFrame, index: PostingsIndex, k: int, first: int):
    """(ids, vectors, opening blocks, limits) of each block of queries; those without terms find nothing."""
    for part in blocks(queries, "query_id", queries.count(), BLOCK_VECTORS):
        names, table = vectors_of(part, index.dimension)
        kept = np.flatnonzero(table.any(axis=1))
        names, table = [names[i] for i in kept], table[kept]
        opening = _opening(names, table, index, first) if names else {}
        if opening:
            yield names, table, opening, _limits(names, table, index, k, opening)


def blocked_topk(queries: DataFrame, index: PostingsIndex, k: int = SETTINGS.top_k, first: int = 4) -> DataFrame:
    """(query_id, rank, distance, id, source, chunk_index) of the k nearest chunks of each of (query_id, query)."""
    dimension, parts = index.dimension, []
    for names, table, _, limits in _asked(queries, index, k, first):

        def search(batches, names=names, table=table, limits=limits):
            for batch in _slices(batches):
                yield from _score(names, table, batch, _taken(names, table, batch, limits)[0], dimension, k)

        parts.append(index.lists.mapInArrow(search, HIT_ROWS))
    empty = queries.sparkSession.createDataFrame([], HIT_ROWS)
    return _ranked(reduce(DataFrame.unionByName, parts) if parts else empty, k)


def blocks_read(queries: DataFrame, index: PostingsIndex, k: int = SETTINGS.top_k, first: int = 4) -> DataFrame:
    """(query_id, n_blocks, n_read): the blocks that share a bucket with a query, and those whose vectors it reads."""
    parts = []
    for names, table, opening, limits in _asked(queries, index, k, first):

        def count(batches, names=names, table=table, opening=opening, limits=limits):
            for batch in _slices(batches):
                at = batch.column("block").to_pylist()
                taken, shared = _taken(names, table, batch, limits)
                taken |= np.array([[b in opening.get(n, ()) for b in at] for n in names])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(shared.sum(axis=1)), pa.array(taken.sum(axis=1))], names=["query_id", "n_blocks", "n_read"])

        parts.append(index.lists.select("block", "impacts").mapInArrow(count, "query_id long, n_blocks long, n_read long"))
    empty = queries.sparkSession.createDataFrame([], "query_id long, n_blocks long, n_read long")
    return (reduce(DataFrame.unionByName, parts) if parts else empty).groupBy("query_id").agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_read").alias("n_read")).where("n_blocks > 0")

"""Exact nearest neighbours with an index of balls: what the triangle inequality rules out is not looked at.

The index gives every vector to its nearest pivot (a bounded sample of the vectors) and cuts each pivot's cell into rings
of at most ``block_rows`` vectors by their distance from it.  A block knows its ring's two radii, so a query knows how far
away the nearest vector of the block must be at least.  A search looks at the best blocks of the query's own cell first;
the k-th distance found there rules out cells, and then rings, that begin beyond it.

Blocks are rows of a table, written once; only those that some query needs meet queries, in one join, whatever the number
of queries.  Cosine distances are ruled out by the distances of unit vectors, of which they are half the square.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .running import numbered

#: Query vectors that meet a block at once, and what a bound may be wrong by.
QUERY_ROWS, SLACK = 1024, 1e-6


@dataclass
class VectorIndex:
    """``blocks``: (block, pivot, lo, hi, n, ids, vectors); pivot -1 holds vectors without a direction."""

    blocks: DataFrame
    pivots: np.ndarray
    metric: str
    dimension: int


def _directed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """What distances from pivots are taken of; zero vectors become NaN under cosine."""
    if metric == "l2":
        return vectors
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _from_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)


def index_vectors(base: DataFrame, dimension: int, metric: str = "cosine", block_rows: int = 512, most_pivots: int = 256) -> VectorIndex:
    """The index of (vec_id, embedding); rows of another dimension or without an id are left out."""
    sized = base.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dimension)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    n = sized.count()
    wanted = int(min(most_pivots, max(1, n**0.5)))
    drawn = sized.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // (4 * wanted)))) == 0).limit(wanted).collect()  # at most most_pivots vectors
    pivots = _directed(np.array([r.embedding for r in drawn or sized.limit(1).collect()], dtype=float).reshape(-1, dimension), metric)
    pivots = pivots[~np.isnan(pivots).any(axis=1)]

    def assign(batches):
        for batch in batches:
            vectors = _directed(_matrix(batch.column("embedding"), dimension), metric)
            pivot, distance = np.full(len(vectors), -1, dtype=np.int32), np.zeros(len(vectors))
            known = np.flatnonzero(~np.isnan(vectors).any(axis=1)) if len(pivots) else np.zeros(0, np.int64)
            if len(known):
                all_distances = _from_pivots(vectors[known], pivots)
                pivot[known] = all_distances.argmin(axis=1)
                distance[known] = all_distances.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(pivot), pa.array(distance)], names=["vec_id", "embedding", "pivot", "distance"])

    assigned = sized.mapInArrow(assign, "vec_id long, embedding array<float>, pivot int, distance double")
    ringed = numbered(assigned, ["pivot"], ["distance", "vec_id"]).withColumn("ring", F.floor(F.col("nth") / block_rows))
    packed = ringed.groupBy("pivot", "ring").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))  # at most block_rows
    block = F.concat_ws("-", F.col("pivot").cast("string"), F.col("ring").cast("string"))
    return VectorIndex(stored(packed.select(block.alias("block"), "pivot", "lo", "hi", "n", F.transform("rows", lambda r: r["vec_id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["embedding"])).alias("vectors")), "vector-index"), pivots, metric, dimension)


def _looked_at(pairs: DataFrame, queries: DataFrame, index: VectorIndex, k: int, groups: int) -> DataFrame:
    """The best k of each (query_id, block) pair: (query_id, vec_id, distance)."""
    dimension, metric = index.dimension, index.metric
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    asked = pairs.join(queries, "query_id").groupBy("block", group.alias("part")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))  # about QUERY_ROWS
    asked = asked.select("block", F.transform("q", lambda r: r["query_id"]).alias("query_ids"), F.flatten(F.transform("q", lambda r: r["embedding"])).alias("query_vectors"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])

    def look(batches):
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            names, ids = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("query_ids", "ids"))
            left, right = _matrix(batch.column("query_vectors"), dimension), _matrix(batch.column("vectors"), dimension)
            if metric == "cosine":
                distance = 1 - _directed(left, metric) @ _directed(right, metric).T
            else:
                distance = np.stack([np.sqrt(((q - right) ** 2).sum(axis=1)) for q in left])
            distance = np.round(distance, 9)
            best = np.stack([np.lexsort((ids, row))[:k] for row in distance])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(distance, best, axis=1).ravel())], schema=schema)

    return asked.join(index.blocks.select("block", "ids", "vectors"), "block").select("query_ids", "query_vectors", "ids", "vectors").mapInArrow(look, "query_id long, vec_id long, distance double")


def nearest(queries: DataFrame, index: VectorIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, vec_id, distance, rank) by exact distances, ties by id; the (query_id, block) pairs that were looked at)."""
    pivots, metric, dimension = index.pivots, index.metric, index.dimension
    asked = stored(queries.where(F.size("embedding") == dimension).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")), "queries")
    groups = max(1, -(-asked.count() // QUERY_ROWS))

    def place(batches):
        for batch in batches:
            vectors = _directed(_matrix(batch.column("embedding"), dimension), metric)
            distance = np.nan_to_num(np.column_stack([np.zeros(len(vectors)), _from_pivots(vectors, pivots)]) if len(pivots) else np.zeros((len(vectors), 1)))
            lost = np.isnan(vectors).any(axis=1)  # no bound holds for a query without a direction
            ids = np.repeat(batch.column("query_id").to_numpy(zero_copy_only=False), distance.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(-1, distance.shape[1] - 1, dtype=np.int32), len(vectors))), pa.array(distance.ravel()), pa.array(np.repeat(lost, distance.shape[1]))], names=["query_id", "pivot", "from_pivot", "lost"])

    placed = asked.mapInArrow(place, "query_id long, pivot int, from_pivot double, lost boolean")
    rings = index.blocks.select("block", "pivot", "lo", "hi", "n")
    cells = rings.groupBy("pivot").agg(F.min("lo").alias("cell_lo"), F.max("hi").alias("cell_hi"))  # one row a pivot
    beyond = lambda lo, hi: F.when(F.col("lost"), 0.0).when(F.col("pivot") < 0, F.lit(float("inf"))).otherwise(F.greatest(F.col("from_pivot") - F.col(hi), F.col(lo) - F.col("from_pivot"), F.lit(0.0)))
    near = stored(placed.join(F.broadcast(cells), "pivot").withColumn("cell_bound", beyond("cell_lo", "cell_hi")), "near-cells")  # at most most_pivots rows are broadcast
    own = near.groupBy("query_id").agg(F.min_by("pivot", F.struct("cell_bound", "from_pivot", "pivot")).alias("pivot"))
    inside = Window.partitionBy("query_id").orderBy("bound", "block")  # the rings of one cell
    ranked = near.join(own, ["query_id", "pivot"]).join(rings, "pivot").withColumn("bound", beyond("lo", "hi")).withColumn("before", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = stored(ranked.where(F.col("before") < k).select("query_id", "block"), "first-blocks")
    found = stored(_looked_at(first, asked, index, k, groups), "first-found")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.nanvl("distance", F.lit(float("inf"))).alias("kth"))
    far = F.coalesce("kth", F.lit(float("inf")))  # fewer than k were found
    reach = (far if metric == "l2" else F.sqrt(2 * F.greatest(far, F.lit(0.0)) + SLACK**2)) + SLACK
    open_cells = near.join(kth, "query_id", "left").withColumn("reach", reach).where(F.col("cell_bound") <= F.col("reach"))
    rest = open_cells.join(rings, "pivot").where(beyond("lo", "hi") <= F.col("reach")).select("query_id", "block").join(first, ["query_id", "block"], "left_anti")
    rest = stored(rest, "other-blocks")
    both = found.unionByName(_looked_at(rest, asked, index, k, groups))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), first.unionByName(rest)

"""Best-fit packing of documents into sequences by exact complements.

Only lengths matter for where a piece goes, and there are at most ``capacity`` of them.  So Spark
counts pieces by length, the driver plans on that histogram (at most ``capacity`` numbers, however
large the corpus), and Spark gives every piece its place from its rank among pieces of its length:

1. ``plan``: for each length, longest first, the gap it leaves is looked up in the index of single
   lengths and of pair sums (triples through the pairs that are left of them); combinations that fill it exactly are consumed as often
   as availability counts allow.  What is left is packed best fit, longest first.
2. ``place``: ranks come from a running count inside each write task plus the counts of the tasks
   before; no length class is ever gathered in one task.

Defined results: null text is empty (its ids are the end id alone); rows that repeat an id are
packed row by row; null ids are carried; an empty table gives an empty result; other columns are
ignored.  Documents longer than the capacity are cut into full pieces, the last may be shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, stored, texts_of
from .encoding import encoding

END_ID = 0
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of all documents, each with the task that wrote it and its rank there among pieces of its length."""

    def encode(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        with encoding(vocabulary) as one:
            for batch in pieces(batches, 512):
                rows = [[] for _ in _PIECES]
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = one.encode_u32(text) + END_ID.to_bytes(4, "little")
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        length = len(part) // 4
                        for column, value in zip(rows, (doc_id, n, at // 4, length, zlib.crc32(part), task, seen[length]), strict=True):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)

    return stored(texts_of(docs).mapInArrow(encode, PIECES_DDL), "pieces")


class _Complements:
    """Which lengths are available and which sums of two of them there are."""

    def __init__(self, available: np.ndarray):
        self.left = available.astype(np.int64)
        self.capacity = len(available) - 1
        self.pairs = np.zeros(2 * self.capacity + 1, dtype=np.int64)
        lengths = np.flatnonzero(self.left)
        for x in lengths:
            self.pairs[x + lengths[lengths >= x]] += 1

    def take(self, combination: dict[int, int], times: int) -> None:
        for x, k in combination.items():
            self.left[x] -= k * times
            if self.left[x] == 0:
                others = np.flatnonzero(self.left)
                self.pairs[x + others] -= 1
                self.pairs[2 * x] -= 1

    def enough(self, *lengths: int) -> bool:
        """Whether every length is left as often as it occurs here."""
        return all(self.left[x] >= k for x, k in Counter(lengths).items())

    def pair(self, gap: int, most: int, *held: int) -> tuple[int, int] | None:
        """The most even pair with this sum (very short lengths are kept for odd gaps) that can be taken together
        with ``held``; neither is above ``most``."""
        if gap < 2 or not self.pairs[gap]:
            return None
        large = np.arange((gap + 1) // 2, min(most, gap - 1) + 1)
        for x in large[(self.left[large] > 0) & (self.left[gap - large] > 0)].tolist():
            if self.enough(*held, x, gap - x):
                return x, gap - x
        return None

    def triple(self, gap: int, most: int, *held: int) -> tuple[int, int, int] | None:
        large = np.arange((gap + 2) // 3, min(most, gap - 2) + 1)
        for x in large[(self.left[large] > 0) & (self.pairs[gap - large] > 0)].tolist():
            if two := self.pair(gap - x, x, *held, x):
                return (x, *two)
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences as (lengths with how often each occurs, number of such sequences)."""
    available = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        available[length] = n
    index, patterns = _Complements(available), []
    for x in range(capacity, 0, -1):
        while index.left[x]:
            gap = capacity - x
            if gap == 0:
                found = ()
            elif gap <= x and index.enough(x, gap):
                found = (gap,)
            else:
                found = index.pair(gap, x, x) or index.triple(gap, x, x)
            if found is None:
                break
            combination = Counter((x, *found))
            times = min(int(index.left[y]) // k for y, k in combination.items())
            index.take(combination, times)
            patterns.append((dict(combination), times))
    return patterns + _best_fit(index.left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the open sequence with the smallest gap that holds it; alike sequences are one group."""
    gaps: list[int] = []
    groups: dict[int, list[tuple[Counter, int]]] = defaultdict(list)

    def put(gap: int, group: Counter, times: int) -> None:
        if not groups[gap]:
            insort(gaps, gap)
        groups[gap].append((group, times))

    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                each = capacity // x
                if full := n // each:
                    put(capacity - each * x, Counter({x: each}), full)
                if n % each:
                    put(capacity - (n % each) * x, Counter({x: n % each}), 1)
                break
            gap = gaps[at]
            group, times = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(at)
            each = min(gap // x, max(n // times, 1))
            used = min(times, n // each)
            if used < times:
                put(gap, group, times - used)
            put(gap - each * x, group + Counter({x: each}), used)
            n -= each * used
    return [(dict(group), times) for found in groups.values() for group, times in found]


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """By length: from which rank on pieces go where.  Ranks r from ``first`` on go to sequence + (r - first) % times."""
    rows, taken, sequence = [], Counter(), 0
    for combination, times in patterns:
        offset = 0
        for x, k in sorted(combination.items(), reverse=True):
            rows.append((x, taken[x], sequence, times, offset))
            taken[x] += k * times
            offset += k * x
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "sequence", "times", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut_up = cut(docs, vocabulary, capacity)
    counts = cut_up.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = _slots(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut_up.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))

    def place(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                lo, hi = np.searchsorted(slots["length"], [x, x + 1])
                mine = length == x
                at[mine] = lo + np.searchsorted(slots["first"][lo:hi], rank[mine], side="right") - 1
            past = rank - slots["first"][at]
            sequence = slots["sequence"][at] + past % slots["times"][at]
            offset = slots["offset"][at] + past // slots["times"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], schema=_PLACED)

    return ranked.mapInArrow(place, PLACED_DDL)


def pack_words(docs: DataFrame) -> DataFrame:
    """``pack`` with the public 49k vocabulary and sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))

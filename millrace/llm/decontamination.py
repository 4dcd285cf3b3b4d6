"""Benchmark decontamination by SimHash windows, a multi-index over Hamming blocks and exact verification.

For every benchmark item, windows of its number of words slide over every document.  A window is
fingerprinted (128-bit SimHash of its five-word shingles, each as often as it occurs) and looked up
in a multi-index of the items: fingerprints are cut into 8 blocks of 16 bits, and every block value
within 3 bits of an item's block leads to the item.  A fingerprint within Hamming distance 31 agrees
with the item's to 3 bits in at least one of 8 blocks, so the index finds all of them.  Each found
pair is then decided exactly: sum of least over sum of greatest shingle counts, in percent.

Two exact bounds stand around the fingerprints.  Windows that share too few shingles with an item to
reach the threshold are not fingerprinted, which loses nothing.  And a window beyond the radius that
shares enough to be alike, or more alike than the best one found, is decided too: about one window in
700 at a similarity of exactly 0.8 lies there.  So results are those of comparing every window.
A document shorter than the item is one window.

Items are taken in blocks of at most ``items_per_pass``; tasks hold one block's index, whose size
that bounds.  With more than one block, documents without any benchmark shingle (a fixed-size bit
table over all items, no false negatives) are left out of the passes.

Defined results: null and empty texts, of documents or items, match nothing; a text of fewer than
five words is one shingle and matches only a whole document of the same words; a null id is carried;
items that repeat give a row each; rows that repeat an id give a row each; empty tables give empty
results; other columns are ignored by :func:`matches`, carried by :func:`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, texts_of
from .textkernel import WORD_BLOCK_BYTES, batch_blocks, find_words, hash_spans, mix64, shingle_hashes

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
_FLIPS = np.array([0, *(sum(1 << b for b in bits) for k in range(1, BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), k))], dtype=np.int64)
_BIT_TABLE = 1 << 26
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
MATCHES_DDL = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _shingled(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row by row: number of words and shingle hashes in order."""
    for first, end, data, offsets in batch_blocks(texts, WORD_BLOCK_BYTES):
        starts, ends, rows = find_words(data, offsets)
        shingles, at, _ = shingle_hashes(hash_spans(data, starts, ends), rows, size)
        words = np.bincount(rows, minlength=end - first)
        bounds = np.searchsorted(at, np.arange(end - first + 1))
        for r in range(end - first):
            yield int(words[r]), shingles[bounds[r] : bounds[r + 1]]


def _bits(shingles: np.ndarray) -> np.ndarray:
    """128 signs (+1, -1) for each shingle."""
    both = np.stack([shingles, mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def simhashes(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints (8 blocks of 16 bits) of the windows of ``length`` shingles that begin at ``starts``."""
    lo, hi = int(starts.min()), int(starts.max()) + length
    sums = np.zeros((hi - lo + 1, 128), dtype=np.int32)
    np.cumsum(_bits(shingles[lo:hi]), axis=0, out=sums[1:])
    signs = sums[starts - lo + length] - sums[starts - lo] > 0
    return np.packbits(signs, axis=1).view(np.uint16)


class ItemIndex:
    """Items of one pass: their shingles and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int | None, int, np.ndarray]], percent: int):
        self.percent = percent
        self.ids = [i for i, _, _ in items]
        self.words = np.array([w for _, w, _ in items], dtype=np.int64)
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)), strict=True)) for _, _, s in items]
        self.sizes = np.array([len(s) for _, _, s in items], dtype=np.int64)
        pairs = sorted((h, k) for k, counts in enumerate(self.counts) for h in counts)
        self.keys = np.array([h for h, _ in pairs], dtype=np.uint64)
        self.owners = np.array([k for _, k in pairs], dtype=np.int64)
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self.keys & np.uint64((1 << 20) - 1)] = True
        self.prints = np.concatenate([simhashes(s, np.zeros(1, np.int64), len(s)) for _, _, s in items]) if items else np.zeros((0, BLOCKS), np.uint16)
        near = (self.prints.astype(np.int64)[:, :, None] ^ _FLIPS).transpose(1, 0, 2).reshape(BLOCKS, -1)
        item = np.repeat(np.arange(len(items)), len(_FLIPS))
        self.blocks = []
        for values in near:
            order = np.argsort(values, kind="stable")
            self.blocks.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)), item[order].astype(np.int32)))

    def within_radius(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for all fingerprints at Hamming distance RADIUS or less."""
        for w, blocks in enumerate(prints):
            found = np.unique(np.concatenate([items[bounds[v] : bounds[v + 1]] for (bounds, items), v in zip(self.blocks, blocks.tolist(), strict=True)]))
            if len(found):
                distance = np.bitwise_count(self.prints[found] ^ blocks).sum(axis=1)
                for k in found[distance <= RADIUS]:
                    yield w, int(k)

    def similarity(self, window: np.ndarray, k: int) -> tuple[int, int]:
        """Sum of least and sum of greatest counts of the window's and the item's shingles."""
        counts, least = self.counts[k], 0
        for h, n in zip(*(x.tolist() for x in np.unique(window, return_counts=True)), strict=True):
            least += min(n, counts.get(h, 0))
        return least, len(window) + int(self.sizes[k]) - least

    def search(self, words: int, shingles: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Items found in a document: the best window's sums of least and greatest counts, and its first word."""
        at = np.flatnonzero(self.table[shingles & np.uint64(len(self.table) - 1)])
        if not len(at) or not len(self.keys):
            return {}
        lo, hi = np.searchsorted(self.keys, shingles[at]), np.searchsorted(self.keys, shingles[at], side="right")
        hits: dict[int, list[int]] = {}
        for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in self.owners[a:b].tolist():
                hits.setdefault(k, []).append(p)
        best: dict[int, tuple[int, int, int]] = {}
        windows: dict[int, set[int]] = {}
        bounds: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # length, window starts and the most they can share

        def verify(k: int, first: int, length: int) -> None:
            least, most = self.similarity(shingles[first : first + length], k)
            if 100 * least >= self.percent * most and (k not in best or (least * best[k][1], -first) > (best[k][0] * most, -best[k][2])):
                best[k] = (least, most, first)

        for k, where in hits.items():
            length = min(int(self.sizes[k]), len(shingles))
            needed = -(-self.percent * (length + int(self.sizes[k])) // (100 + self.percent))
            where = np.array(where)
            starts = np.arange(max(0, where[0] - length + 1), min(where[-1], len(shingles) - length) + 1)
            shared = np.searchsorted(where, starts + length) - np.searchsorted(where, starts)
            starts, shared = starts[shared >= needed], shared[shared >= needed]
            if len(starts):
                windows.setdefault(length, set()).update(starts.tolist())
                bounds[k] = (length, starts, shared)
        seen: set[tuple[int, int]] = set()
        for length, chosen in windows.items():
            starts = np.array(sorted(chosen))
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * length) + 1):
                for w, k in self.within_radius(simhashes(shingles, run, length)):
                    verify(k, int(run[w]), length)
                    seen.add((k, int(run[w])))
        for k, (length, starts, shared) in bounds.items():  # beyond the radius: what could still be alike, or more alike
            for i in np.argsort(-shared, kind="stable").tolist():
                c, most = int(shared[i]), length + int(self.sizes[k])
                if k in best and c * (best[k][1] + best[k][0]) < best[k][0] * most:
                    break
                if (k, int(starts[i])) not in seen:
                    verify(k, int(starts[i]), length)
        return best


def _item_passes(benchmark: DataFrame, size: int, items_per_pass: int, percent: int) -> tuple[Iterator[ItemIndex], int, np.ndarray | None]:
    """The indexes of all passes one after another, their number and, for several, the bit table of all shingles."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n = items.count()
    passes = max(1, -(-n // items_per_pass))

    def load(part: int) -> list[tuple[int | None, int, np.ndarray]]:
        rows = (items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part)).collect()  # about items_per_pass items
        return [(r.item_id, *s) for r, s in zip(rows, _shingled(pa.array([r.text for r in rows], pa.string()), size), strict=True)]

    if passes == 1:
        return iter([ItemIndex(load(0), percent)]), 1, None
    table = np.zeros(_BIT_TABLE, dtype=bool)
    for part in range(passes):
        for _, _, shingles in load(part):
            table[shingles & np.uint64(_BIT_TABLE - 1)] = True
    return (ItemIndex(load(part), percent) for part in range(passes)), passes, np.packbits(table, bitorder="little")


def _touched(table: np.ndarray, size: int, at: int = 1, touched: bool = True):
    """Keep rows whose text (column number ``at``) holds at least one benchmark shingle, or the others."""

    def keep(batches):
        for batch in batches:
            ok = [bool(((table[(s & np.uint64(_BIT_TABLE - 1)) >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1).any()) == touched for _, s in _shingled(batch.column(at), size)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return keep


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80, size: int = 5, items_per_pass: int = 1000) -> DataFrame:
    """One row for each document and item where some window is similar: doc_id, item_id, similarity, first_word, n_words."""
    docs = texts_of(docs)
    indexes, passes, table = _item_passes(benchmark, size, items_per_pass, percent)
    if passes > 1:
        docs = stored(docs.mapInArrow(_touched(table, size), "doc_id long, text string"), "touched")
    out = None
    for index in indexes:

        def find(batches, index=index):
            for batch in batches:
                rows = [[], [], [], [], []]
                for doc_id, (words, shingles) in zip(batch.column("doc_id").to_pylist(), _shingled(batch.column("text"), size), strict=True):
                    for k, (least, most, first) in sorted(index.search(words, shingles).items()):
                        for column, value in zip(rows, (doc_id, index.ids[k], least / most, first, min(words, int(index.words[k]))), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _MATCHES, strict=True)], schema=_MATCHES)

        found = docs.mapInArrow(find, MATCHES_DDL)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, size: int = 5, items_per_pass: int = 1000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no benchmark item is found in; rows are judged in place, without
    a join.  With several passes only rows that hold some benchmark shingle go through them, written every few passes."""
    indexes, passes, table = _item_passes(benchmark, size, items_per_pass, percent)
    schema, at = docs.schema, docs.columns.index("text")
    clean = None
    if passes > 1:
        clean = docs.mapInArrow(_touched(table, size, at, False), schema)
        docs = stored(docs.mapInArrow(_touched(table, size, at), schema), "touched")
    for number, index in enumerate(indexes):

        def keep(batches, index=index):
            for batch in batches:
                ok = [not index.search(words, shingles) for words, shingles in _shingled(batch.column(at), size)]
                yield batch.filter(pa.array(ok, pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
        if number % 8 == 7:
            docs = stored(docs, "touched")
    return docs if clean is None else clean.union(docs)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

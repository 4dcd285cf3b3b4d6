"""A bit table over 64-bit values, bounded in size, that scans use to leave out rows no join would find.

It lets every value of the table it was made from pass and few others, which later joins sort out; so
rows with long texts that a join would drop need not travel.  With far more values than bits it lets
everything pass: slower, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import mix64

MOST_BITS = 26  # 8 MB at most


class Sieve:
    def __init__(self, table: DataFrame, column: str, bits: int | None = None):
        """``table``: stored; nulls are left out.  ``bits``: log2 of the table's size, 16 for each value unless given."""
        values = table.where(table[column].isNotNull()).select(table[column].cast("long").alias("value"))
        self.bits = bits or min(MOST_BITS, max(16, int(values.count() * 16).bit_length()))
        places = self._places

        def mark(batches):
            marks = np.zeros(1 << self.bits, dtype=bool)
            for batch in batches:
                marks[places(batch.column("value").to_numpy(zero_copy_only=False))] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["bits"])

        self.table = np.zeros(1 << self.bits >> 3, dtype=np.uint8)
        for r in values.coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():
            self.table |= np.frombuffer(r.bits, dtype=np.uint8)

    def _places(self, values: np.ndarray) -> np.ndarray:
        return (mix64(values.astype(np.int64).view(np.uint64).copy()) >> np.uint64(64 - self.bits)).astype(np.int64)

    def passes(self, values: np.ndarray) -> np.ndarray:
        at = self._places(values)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def rows(self, column: pa.Array) -> np.ndarray:
        """Which rows pass; null does not."""
        return self.passes(column.fill_null(0).to_numpy(zero_copy_only=False)) & column.is_valid().to_numpy(zero_copy_only=False)


def parted(docs: DataFrame, key: str, sieve: Sieve) -> Callable[[bool], DataFrame]:
    """``docs``, all columns, split in place: rows whose ``key`` passes, and the others."""
    schema, at = docs.schema, docs.columns.index(key)

    def part(passing: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(sieve.rows(batch.column(at).cast(pa.int64())) == passing))

        return docs.mapInArrow(run, schema)

    return part

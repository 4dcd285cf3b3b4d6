"""Tables of one folder in buckets by a hash of their key, changed by numbered commits.

A commit writes new files and, last, a marker that lists the files which make up each bucket from then on; what has no
marker is never read, so a job that is lost or runs again leaves what was there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "name string, bucket int, batch bigint, value bigint"


@dataclass
class State:
    """The batch it was left by, the batches whose files make up each bucket of each table, and named totals."""

    batch: int = -1
    files: dict[tuple[str, int], list[int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)


class Buckets:
    def __init__(self, spark: SparkSession, path: str, buckets: int, schemas: dict[str, str]):
        self.spark, self.path, self.buckets, self.schemas = spark, path, buckets, schemas

    def committed(self) -> list[int]:
        """Numbers of the batches whose markers are complete."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def state(self) -> State:
        found, done = State(), self.committed()
        if done:
            found.batch = done[-1]
            for r in self.spark.read.schema(MARKER).parquet(f"{self.path}/commits/batch={done[-1]}").toLocalIterator():  # files of each bucket, and totals
                if r.bucket < 0:
                    found.totals[r.name] = r.value
                else:
                    found.files.setdefault((r.name, r.bucket), []).append(r.batch)
        return found

    def begun(self, batch: int) -> State | None:
        """The state that ``batch`` starts from, or None where it is committed already."""
        done = self.committed()
        if batch in done:
            return None
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        return self.state()

    def table(self, state: State, name: str, buckets: list[int] | None = None) -> DataFrame:
        wanted = range(self.buckets) if buckets is None else buckets
        paths = [f"{self.path}/{name}/batch={n}/bucket={b}" for b in wanted for n in state.files.get((name, b), [])]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, key: str, *keys: DataFrame) -> list[int]:
        """Buckets that hold the keys: at most all of them."""
        found: set[int] = set()
        for df in keys:
            found |= {r.b for r in df.select(self.bucket(key).alias("b")).distinct().toLocalIterator()}
        return sorted(found)

    def write(self, name: str, rows: DataFrame, key: str, batch: int, by: list[str]) -> tuple[DataFrame, list[int]]:
        """New files of a table, split evenly however many rows share a key; the rows as written, and their buckets."""
        self._save(name, rows.withColumn("bucket", self.bucket(key)).repartitionByRange("bucket", *by), batch, "overwrite")
        return self.written(name, batch)

    def keep(self, name: str, rows: DataFrame, key: str, batch: int, more: bool) -> None:
        """New files of rows that were read from their buckets, without a shuffle, as a bucket's files are split evenly; ``more`` adds to what the batch wrote."""
        self._save(name, rows.withColumn("bucket", self.bucket(key)), batch, "append" if more else "overwrite")

    def _save(self, name: str, placed: DataFrame, batch: int, mode: str) -> None:
        placed.drop("_key").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch}")

    def written(self, name: str, batch: int) -> tuple[DataFrame, list[int]]:
        """The rows that a batch wrote, and their buckets."""
        path = f"{self.path}/{name}/batch={batch}"
        rows = self.spark.read.schema(f"{self.schemas[name]}, bucket int").option("basePath", path).parquet(path)
        return rows.drop("bucket"), [r.bucket for r in rows.select("bucket").distinct().toLocalIterator()]

    def replace(self, state: State, name: str, old: list[int], batch: int, new: list[int]) -> None:
        """From now on the ``old`` buckets hold only what ``batch`` wrote, and ``new`` ones that too."""
        for b in old:
            state.files.pop((name, b), None)
        for b in new:
            state.files.setdefault((name, b), []).append(batch)

    def commit(self, batch: int, state: State) -> None:
        rows = [(name, b, n, None) for (name, b), files in sorted(state.files.items()) for n in files] + [(t, -1, batch, n) for t, n in state.totals.items()]
        self.spark.createDataFrame(rows, MARKER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

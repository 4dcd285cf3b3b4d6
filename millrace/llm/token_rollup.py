"""Token counts as rollups kept up to date by deltas.

A batch of changes (op, doc_id, source, lang, version, tokens) holds inserts, deletes and revised
counts.  ``commit`` turns it into signed entries: +tokens for what a document now counts, -tokens
for what it counted before, and stores under the batch's number:

* ``entries``: signed entries by document, in buckets by a hash of the id: the ledger that later
  batches read old counts from, only in the buckets they touch;
* ``totals``: their sums by source, language and tokenizer version;
* ``commits``: written last, with a fingerprint of the changes.  What has no commit is never read.

Totals are additive, so the rollup is the sum of all batches' totals.  A batch is computed from the
batches before it alone, and committing it again with the same changes does nothing; other changes
under its number, or a number before the last, are refused.  ``compact`` sums the ledger up, so that
later batches read one entry for a document.

Within a batch the last change of a (document, version) by ``seq`` counts (ties: the larger tokens).
Inserting a known document replaces it, deleting an unknown one does nothing, revising an unknown
one inserts it.

Defined results: null source, language or id are values of their own; null text counts no tokens;
rows that repeat an id in one batch are one document (the query tells its rows apart by a number, so
that each counts); an empty batch commits empty tables; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, stored
from .encoding import encoding

ENTRIES = "doc_id string, source string, lang string, version string, docs long, tokens long"
TOTALS = "source string, lang string, version string, docs long, tokens long"

#: Tokenizers that SQL can express, by version: words, and runs of letters, of digits and of other signs.
REGEX_VERSIONS = {"words/1": WORD, "pieces/1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"}


def regex_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def counted_by_vocabulary(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """(doc_id, source, lang, version, tokens) by a tokenizers vocabulary file."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("version", pa.string()), ("tokens", pa.int64())])

    def run(batches):
        with encoding(vocabulary) as one:
            for batch in batches:
                counts = [len(one.encode_u32(t)) // 4 for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long")


class TokenRollup:
    """The ledger and the totals in one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _numbers(self, table: str, column: str) -> dict[int, str]:
        """Fingerprint (or nothing) by number of the markers in ``table``."""
        try:
            rows = self.spark.read.schema(f"fingerprint string, {column} int").parquet(f"{self.path}/{table}").collect()  # one row a batch
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r[column]: r.fingerprint for r in rows}

    def _read(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/batch={n}" for n in batches))

    def _ledger(self, batches: list[int]) -> DataFrame:
        """Entries of the newest sum that covers no other batches, and of the batches after it."""
        base = max((n for n in self._numbers("summed", "upto") if n in batches), default=None)
        later = self._read("entries", f"{ENTRIES}, bucket int", [n for n in batches if base is None or n > base])
        return later if base is None else later.unionByName(self.spark.read.schema(f"{ENTRIES}, bucket int").parquet(f"{self.path}/sums/upto={base}/entries"))

    def _mark(self, table: str, column: str, number: int, fingerprint: str | None) -> None:
        self.spark.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{table}/{column}={number}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _write_entries(self, entries: DataFrame, path: str) -> None:
        spread = entries.withColumn("bucket", self._bucket()).repartition("bucket", "source", "lang")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply ``changes`` (op: insert, delete or revise; seq optional) as batch number ``batch``."""
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        changes = changes.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", "version", F.col("tokens").cast("long").alias("tokens"), "op", seq.cast("long").alias("seq"))
        whole = changes.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*changes.columns).cast("decimal(38,0)"))).first()
        fingerprint, done = f"{whole[0]}:{whole[1]}", self._numbers("commits", "batch")
        if batch in done:
            if done[batch] != fingerprint:
                raise ValueError(f"batch {batch} was committed with other changes")
            return
        if done and batch < max(done):
            raise ValueError(f"batch {batch} comes after batch {max(done)}")
        latest = Window.partitionBy("doc_id", "version").orderBy(F.desc("seq"), F.col("tokens").desc_nulls_last(), F.col("source").desc_nulls_last(), F.col("lang").desc_nulls_last(), F.col("op"))
        new = changes.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1")
        touched = [r.bucket for r in new.select(self._bucket().alias("bucket")).distinct().collect()] if done else []  # at most all buckets
        if touched:
            known = self._ledger(sorted(done)).where(F.col("bucket").isin(touched))
            old = known.groupBy("doc_id", "source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0")
            hit = new.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
            gone = old.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("version").eqNullSafe(F.col("_version")), "left_semi")
            signed = gone.select("doc_id", "source", "lang", "version", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        else:
            signed = self.spark.createDataFrame([], ENTRIES)
        added = new.where("op <> 'delete'").select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        self._write_entries(added.unionByName(signed), f"{self.path}/entries/batch={batch}")
        entries = self.spark.read.schema(ENTRIES).parquet(f"{self.path}/entries/batch={batch}")
        entries.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        self._mark("commits", "batch", batch, fingerprint)

    def compact(self) -> None:
        """Sum the ledger of all batches so far; later batches read the sums and what came after them."""
        done = sorted(self._numbers("commits", "batch"))
        if done:
            sums = self._ledger(done).groupBy("doc_id", "source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
            self._write_entries(stored(sums, "ledger"), f"{self.path}/sums/upto={done[-1]}/entries")
            self._mark("summed", "upto", done[-1], None)

    def totals(self) -> DataFrame:
        """The rollup: source, lang, version, n_docs, n_tokens; groups that no document is left in are gone."""
        committed = self._read("totals", TOTALS, sorted(self._numbers("commits", "batch")))
        sums = committed.groupBy("source", "lang", "version").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs > 0")


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over the whole table: every document is inserted with its word count; its count by pieces is
    inserted from the character count as a first guess; the guess is revised to the true count; empty documents are
    deleted; the last batch is delivered twice.  Texts are counted once, and each row gets a number with that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = {name: regex_count(docs["text"], pattern).alias(name) for name, pattern in zip(("words", "pieces"), REGEX_VERSIONS.values(), strict=True)}
    number = F.concat_ws(":", docs["doc_id"].cast("string"), F.monotonically_increasing_id().cast("string"))
    rows = stored(docs.select(number.alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.coalesce(docs["n_chars"], F.lit(0)).cast("long").alias("guess"), *counts.values()), "token-counts")
    words, pieces = REGEX_VERSIONS

    def changes(op: str, version: str, tokens: str) -> DataFrame:
        return rows.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.col(tokens).alias("tokens"), F.lit(op).alias("op"))

    rollup = TokenRollup(spark, scratch(spark, "token-rollup"))
    rollup.commit(0, changes("insert", words, "words"))
    rollup.commit(1, changes("insert", pieces, "guess"))
    rollup.commit(2, changes("revise", pieces, "pieces"))
    empty = rows.where("words = 0").select("doc_id", "source", "lang", F.explode(F.array(*map(F.lit, REGEX_VERSIONS))).alias("version"), F.lit(None).cast("long").alias("tokens"), F.lit("delete").alias("op"))
    for _ in range(2):
        rollup.commit(3, empty)
    return rollup.totals()


SQL = r"""
WITH counts AS (
  SELECT source, lang, coalesce(text, '') AS t FROM documents
), versions AS (
  SELECT source, lang, 'words/1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS tokens, t FROM counts
  UNION ALL
  SELECT source, lang, 'pieces/1', len(regexp_extract_all(t, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+')), t FROM counts
)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
FROM versions WHERE regexp_matches(t, '[^\x20\x09-\x0D]') GROUP BY source, lang, version
"""

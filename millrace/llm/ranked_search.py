"""Exact ranked search with posting lists cut into blocks of similar documents.

An item's score of a document is the sum, over the item's terms, of the term's weight times the document's impact for
it (whole numbers; the formulas are at :func:`search`).  Documents are ranked in these steps, all on Spark tables:

1. One pass over the texts keeps, of every document, its length and the counts of terms that some item asks for
   (:func:`term_vectors`).  Document frequencies and lengths of the whole table give weights and impacts.
2. Every document gets a similarity code: the sides of ``CODE_BITS`` random planes on which its weighted vector lies.
   Documents whose codes begin alike are near each other.
3. Documents that hold an item's rarest terms are scored first.  The k-th best score found is a threshold that the true
   one is not below, so an item's terms that together cannot reach it need no posting list: a document has to hold one
   of the others.
4. The posting list of each other term is cut geometrically: documents whose codes agree in as many leading bits as
   the list's length asks for make a block.  A block's summary is the largest impact in it for every term that stands
   beside the list's term in some item, stored as rows.
5. For every item and block, weights times summary bound the score of any document of the block.  Blocks whose bound
   is below the threshold are skipped; documents of the others are scored exactly, and the best k stay.

Nothing is lost: bounds are never below a score, and documents at the threshold are kept.

Blocks are joined and summed by Spark, so no list or block is gathered in a task, whatever its length.  Items are taken
in passes of about ``terms_per_pass`` pairs of item and term; one pass's vocabulary travels with the tasks.

Defined results: null and empty texts have no terms: as documents they count nowhere, as items they have no result; a
null doc_id ranks after all others of equal score; rows that repeat an id are ranked each; items that repeat an id are
answered each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import record, stored, table, texts_of
from .textkernel import LOWER, batch_blocks, find_words, hash_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Planes of a similarity code, documents that a block holds on average, and documents an item scores first.
CODE_BITS, BLOCK_ROWS, FIRST_ROWS = 16, 16, 400
#: Rows up to which a table about items is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Vocabulary:
    """The terms that items ask for, numbered, with what finds them in a buffer of texts."""

    def __init__(self, terms: list[str]):
        self.data = np.frombuffer("".join(terms).encode(), dtype=np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(t.encode()) for t in terms], dtype=np.int64)]
        hashes = hash_spans(self.data, self.offsets[:-1], self.offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms have one hash")

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term in each span, or -1; found by hash, decided by the bytes."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        wanted = hash_spans(data, starts, ends)
        at = np.searchsorted(self.hashes, wanted).clip(max=len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == wanted)
        term, sizes = self.order[at[hit]], (ends - starts)[hit]
        same = sizes == np.diff(self.offsets)[term]
        hit, term, sizes = hit[same], term[same], sizes[same]
        for size in np.unique(sizes).tolist():
            part, inside = sizes == size, np.arange(size)
            equal = (LOWER[data[starts[hit[part], None] + inside]] == self.data[self.offsets[term[part], None] + inside]).all(axis=1)
            out[hit[part][equal]] = term[part][equal]
        return out


def term_vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, doc_id, n, terms, counts) of documents with at least one term: how often each term of the vocabulary occurs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in batch_blocks(batch.column("text")):
                starts, ends, rows = find_words(data, offsets, BETWEEN)
                n, term = np.bincount(rows, minlength=end - first), vocabulary.numbers(data, starts, ends)
                found, counts = np.unique((rows * (len(vocabulary.hashes) + 1) + term)[term >= 0], return_counts=True)
                bounds = np.searchsorted(found, np.arange(end - first + 1) * (len(vocabulary.hashes) + 1))
                terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found % (len(vocabulary.hashes) + 1), pa.int32()))
                sums = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts, pa.int64()))
                yield record({"doc_id": batch.column("doc_id").slice(first, end - first), "n": n, "terms": terms, "counts": sums}, schema).filter(pa.array(n > 0))

    vectors = texts_of(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")
    return stored(vectors.select(F.monotonically_increasing_id().alias("row"), "*"), "term-vectors")


def _with_impacts(vectors: DataFrame, weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """(row, doc_id, code, terms, impacts): terms that weigh something, their impacts and the document's similarity code."""
    planes = np.random.default_rng(12).integers(0, 2, (len(weights), CODE_BITS)) * 2.0 - 1
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("code", pa.int32()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, counts = lists.flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), size)
            kept = weights[terms] > 0
            terms, counts, owner = terms[kept], counts[kept], owner[kept]
            m = 10 + 90 * batch.column("n").to_numpy(zero_copy_only=False) * documents // total
            impacts = 1_000_000_000 * counts // (1000 * counts + 8 * m[owner])
            mass, sides = weights[terms] * impacts.astype(float), np.zeros((batch.num_rows, CODE_BITS))
            for bit in range(CODE_BITS):
                sides[:, bit] = np.bincount(owner, mass * planes[terms, bit], batch.num_rows)
            code = (sides > 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1))
            bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            yield record({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "code": code, "terms": pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())), "impacts": pa.ListArray.from_arrays(bounds, pa.array(impacts, pa.int64()))}, schema)

    return vectors.mapInArrow(run, "row long, doc_id long, code int, terms array<int>, impacts array<long>")


def _exploded(vectors: DataFrame, *keys: str) -> DataFrame:
    return vectors.select(*keys, F.explode(F.arrays_zip("terms", "impacts")).alias("x")).select(*keys, F.col("x.terms").alias("term"), F.col("x.impacts").alias("impact"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Searched:
    """``ranked``: (item, rank, doc_id, row, score); ``blocks``: (item, term, block, bound, kept), for whoever wants to know what was skipped."""

    ranked: DataFrame
    blocks: DataFrame


def _near(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table made on the driver, broadcast where its size allows it."""
    made = spark.createDataFrame(rows, ddl)
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def _rarest(terms: list[int], held: np.ndarray, rows: int) -> list[int]:
    """The rarest terms, as many as it takes until ``rows`` documents hold one."""
    order = sorted(terms, key=lambda t: int(held[t]))
    before = np.cumsum([0, *(int(held[t]) for t in order)])
    return [t for t, n in zip(order, before, strict=False) if n < rows]


def _search_pass(docs: DataFrame, asked: list[tuple[int, str]], k: int) -> Searched:
    """``asked``: all pairs of item and term of one pass."""
    spark = docs.sparkSession
    terms = sorted({t for _, t in asked})
    number = {t: n for n, t in enumerate(terms)}
    vectors = term_vectors(docs, Vocabulary(terms))
    documents, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(terms), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the pass
        held[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in held.tolist()], dtype=np.int64)
    vectors = stored(_with_impacts(vectors, weights, documents, max(total, 1)), "impacts")
    items: dict[int, list[int]] = {}
    for item, term in asked:
        if weights[number[term]] > 0 and held[number[term]]:
            items.setdefault(item, []).append(number[term])
    weighed = [(item, t, int(weights[t])) for item, own in items.items() for t in own]
    weighed_table = _near(spark, weighed, "item long, term int, weight long")

    def scored(candidates: DataFrame) -> DataFrame:
        exact = _exploded(candidates.join(vectors, "row"), "item", "row", "doc_id").join(weighed_table, ["item", "term"])
        return _best(exact.groupBy("item", "row", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")), k)

    rarest = [(item, t) for item, own in items.items() for t in _rarest(own, held, FIRST_ROWS)]
    first = vectors.select("row", F.explode("terms").alias("term")).join(_near(spark, rarest, "item long, term int"), "term").select("item", "row").distinct()
    reached = {r.item: r.score for r in scored(first).where(F.col("rank") == k).select("item", "score").toLocalIterator()}  # one row an item
    largest = np.zeros(len(terms), dtype=np.int64)
    for r in _exploded(vectors).groupBy("term").agg(F.max("impact").alias("most")).toLocalIterator():
        largest[r.term] = r.most

    listed: list[tuple[int, int, int]] = []  # item, term whose list it needs, threshold
    for item, own in items.items():
        reach = np.array([int(weights[t] * largest[t]) for t in own])
        order = np.argsort(reach)
        listed += [(item, own[i], reached.get(item, 0)) for i in order[np.cumsum(reach[order]) >= reached.get(item, 0)]]
    bits = {t: min(CODE_BITS, max(0, int(held[t]) // BLOCK_ROWS).bit_length()) for t in {t for _, t, _ in listed}}
    lists = _near(spark, list(bits.items()), "term int, bits int")
    wanted = _near(spark, listed, "item long, term int, threshold long")
    beside = _near(spark, sorted({(t, other) for item, t, _ in listed for other in items[item]}), "list int, term int")

    block = F.expr(f"shiftright(code, {CODE_BITS} - bits)")
    postings = stored(vectors.select("row", "code", F.explode("terms").alias("term")).join(lists, "term").select(F.col("term").alias("list"), block.alias("block"), "row"), "postings")
    coordinates = _exploded(postings.join(vectors.select("row", "terms", "impacts"), "row"), "list", "block").join(beside, ["list", "term"])
    summaries = stored(coordinates.groupBy("list", "block", "term").agg(F.max("impact").alias("most")), "summaries")

    bounds = summaries.join(wanted.withColumnRenamed("term", "list"), "list").join(weighed_table, ["item", "term"])
    bounds = bounds.groupBy("item", "list", "block", "threshold").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
    blocks = stored(bounds.select("item", F.col("list").alias("term"), "block", "bound", (F.col("bound") >= F.col("threshold")).alias("kept")), "bounds")
    candidates = blocks.where("kept").select("item", F.col("term").alias("list"), "block").join(postings, ["list", "block"]).select("item", "row").distinct()
    return Searched(scored(candidates).select("item", "rank", "doc_id", "row", "score"), blocks)


def numbered_items(items: DataFrame) -> DataFrame:
    """(item, item_id, terms) of items with at least one term, each term once; items are numbered by row."""
    lowered = F.translate(F.coalesce(items["text"], F.lit("")), UPPER_LETTERS, LOWER_LETTERS)
    terms = F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))
    return stored(items.select(F.monotonically_increasing_id().alias("item"), items["item_id"].cast("long").alias("item_id"), terms.alias("terms")), "items").where(F.size("terms") > 0)


def search_passes(docs: DataFrame, items: DataFrame, k: int = 10, terms_per_pass: int = 200_000) -> list[Searched]:
    """``items``: rows of :func:`numbered_items`."""
    pairs = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-pairs // terms_per_pass))
    split = items.select("item", F.explode("terms").alias("term"), F.pmod(F.xxhash64("item"), F.lit(passes)).alias("pass"))
    parts = ([(r.item, r.term) for r in split.where(F.col("pass") == n).toLocalIterator()] for n in range(passes))  # about terms_per_pass rows
    return [_search_pass(docs, asked, k) for asked in parts if asked]


def search(docs: DataFrame, items: DataFrame, k: int = 10, terms_per_pass: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of every item (item_id, text).

    Terms are the longest runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  With N documents
    that have a term, L terms in them, n in the document, df documents holding the term and tf of it in the document:
    weight floor(1000 * ln((2N + 2) / (2df + 1))), impact (10**9 * tf) div (1000 * tf + 8 * m), m = 10 + (90 * n * N) div L.
    """
    named = numbered_items(items)
    found = [s.ranked for s in search_passes(docs, named, k, terms_per_pass)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = reduce(DataFrame.unionByName, found)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_LETTERS}', '{LOWER_LETTERS}'), '{TERM}') AS t FROM documents),
docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0),
whole AS (SELECT count(*) AS docs_n, CAST(sum(n) AS BIGINT) AS terms_n FROM docs),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term, docs_n),
asked AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER_LETTERS}', '{LOWER_LETTERS}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
scores AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs_n) // terms_n))))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (r), whole GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

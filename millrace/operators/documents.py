"""Documents as groups of chunks: roll-up, look-up by key, replacement, deletion, re-chunking, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import UUID_PATTERN, normalise_space, source_label, strip, uuid_of
from ..sources.ingest import to_chunks
from .running import numbered, running_sums


def rollup(chunked: DataFrame) -> DataFrame:
    """(doc_key, source, content, chunk_count): one row per source, chunks without one stand alone."""
    keyed = chunked.withColumn("doc_key", F.coalesce(F.nullif("source", F.lit("")), F.col("id")))
    order = F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "id", "content", "source")
    grouped = keyed.groupBy("doc_key").agg(F.array_sort(F.collect_list(order)).alias("c"))
    return grouped.select("doc_key", F.col("c")[0]["source"].alias("source"), F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("content"), F.size("c").cast("long").alias("chunk_count"))


def counts_by_key(chunked: DataFrame) -> DataFrame:
    """The roll-up without contents: reads two narrow columns."""
    return chunked.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.col("id")).alias("doc_key"), F.nullif("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("chunk_count"))


def dashboard(chunked: DataFrame) -> DataFrame:
    return counts_by_key(chunked).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("chunk_count", F.lit(1))).alias("chunks"), F.countDistinct("source").alias("sources"))


def listing(chunked: DataFrame) -> DataFrame:
    n = F.col("chunk_count")
    return counts_by_key(chunked).select("doc_key", source_label(F.col("source")).alias("label"), n, F.concat(n.cast("string"), F.when(n == 1, " chunk").otherwise(" chunks")).alias("caption"))


def resolve(keys: DataFrame, chunked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found: key, id, source, chunk_index), (missing: key) for ids and sources; an id finds its whole document."""
    keys = keys.select("key").where("key is not null").distinct()
    slim = chunked.select("id", "source", "chunk_index")
    by_id = keys.where(F.col("key").rlike(UUID_PATTERN)).join(slim, F.lower("key") == slim["id"])
    whole = by_id.select("key", F.nullif("source", F.lit("")).alias("wanted"), F.col("id").alias("only"))
    from_source = whole.where("wanted is not null").join(slim, F.col("wanted") == slim["source"]).select("key", "id", "source", "chunk_index")
    alone = by_id.where("nullif(source, '') is null").select("key", "id", "source", "chunk_index")
    rest = keys.join(by_id.select("key"), "key", "left_anti").join(slim, F.col("key") == slim["source"]).select("key", "id", "source", "chunk_index")
    found = from_source.unionByName(alone).unionByName(rest)
    return found, keys.join(found.select("key"), "key", "left_anti")


def replaced(chunked: DataFrame, updates: DataFrame, **chunking) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, new chunks without vectors) when the documents of ``updates`` (doc_id, source, content) are cut again.

    Without content a document's own chunks are joined and cut; blank content changes nothing.
    """
    given, again = updates.where(strip(F.col("content")) != ""), updates.where("content is null").select("source").distinct()
    own = rechunk(chunked.join(again, "source", "left_semi"), **chunking).withColumn("doc_id", F.lit(0).cast("long"))
    changed = given.select("source").unionByName(again).distinct()
    return chunked.join(changed, "source", "left_anti").select(chunked.columns), to_chunks(given, **chunking).unionByName(own)


def replace(chunked: DataFrame, updates: DataFrame, **chunking) -> DataFrame:
    """Chunks after the documents of ``updates`` (doc_id, source, content or null) took the place of those with their source."""
    kept, fresh = replaced(chunked, updates, **chunking)
    return kept.unionByName(fresh)


def delete(chunked: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining chunks, deleted rows by source)."""
    gone = sources.select("source").distinct()
    return chunked.join(gone, "source", "left_anti"), chunked.join(gone, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("deleted"))


def rechunk(chunked: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap, key: str = "source", named_by: Column | None = None) -> DataFrame:
    """Documents cut again from their joined chunks, overlaps included, as an update without content does.

    (id, source, chunk_index, content, doc_id: the key) of all documents whose ``key`` is not null; ``named_by`` tells
    equal texts apart in ids, where the source does not.  No document is ever
    whole in a row: running sums of the chunks' lengths tell where each begins, so each chunk gives its piece to the two
    or three windows that reach into it, and a window joins its pieces.
    """
    step = max(size - overlap, 1)
    clean = chunked.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "source", F.coalesce("chunk_index", F.lit(0)).alias("_i"), "id", normalise_space(F.coalesce("content", F.lit(""))).alias("text")).where("text <> ''")
    placed = running_sums(clean, ["doc_id"], ["_i", "id"], F.length("text") + 1, "start").withColumn("end", F.col("start") + F.length("text"))
    length = placed.groupBy("doc_id").agg(F.max("end").alias("length"))
    last = F.greatest(F.ceil((F.col("length") - size) / step), F.lit(0))  # the number of the last window
    first = F.greatest(F.floor((F.col("start") - size) / step) + 1, F.lit(0))
    reach = F.sequence(first.cast("long"), F.least(F.floor((F.col("end") - 1) / step), last).cast("long"))
    met = placed.join(length, "doc_id").where(first <= last).select("doc_id", "source", "start", "end", "text", F.explode(reach).alias("w"))
    begin = F.greatest(F.col("w") * step - F.col("start"), F.lit(0))
    piece = F.substring("text", (begin + 1).cast("int"), (F.least(F.col("w") * step + size, F.col("end")) - F.col("start") - begin).cast("int"))
    pieces = met.select("doc_id", "source", "w", "start", piece.alias("piece")).where("piece <> ''")
    joined = pieces.groupBy("doc_id", "w").agg(F.max("source").alias("source"), F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))  # at most size pieces
    cut = joined.select("doc_id", "source", "w", F.trim(F.array_join(F.transform("p", lambda x: x["piece"]), " ")).alias("content")).where("content <> ''")
    # only windows of one character can be blank, and leave a gap
    numbers = cut.withColumn("nth", F.col("w")) if size > 1 else numbered(cut, ["doc_id"], ["w"])
    return numbers.select(uuid_of(F.coalesce("source", F.lit("")), F.lit("0") if named_by is None else named_by, F.col("nth").cast("string"), F.col("content")).alias("id"), "source", F.col("nth").cast("int").alias("chunk_index"), "content", "doc_id")


def dimension_violations(vectors: DataFrame, dimension: int) -> DataFrame:
    return vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).select("vec_id", F.size("embedding").alias("found"))


def name_violations(users: DataFrame, least: int = 3, most: int = 80) -> DataFrame:
    """(rule, key): user names of a wrong length and names that differ only in case or outer space."""
    length = F.length("username")
    wrong = users.where(~length.between(least, most) | length.isNull()).select(F.lit("username length").alias("rule"), F.coalesce("username", F.lit("")).alias("key"))
    twice = users.groupBy(F.lower(strip(F.col("username"))).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("username unique").alias("rule"), "key")
    return wrong.unionByName(twice)


def content_violations(documents: DataFrame) -> DataFrame:
    """(rule, key): documents whose content is missing or empty."""
    return documents.where(F.coalesce(F.length("content"), F.lit(0)) < 1).select(F.lit("content length").alias("rule"), F.col("doc_id").cast("string").alias("key"))


def vector_violations(chunked: DataFrame, dimension: int) -> DataFrame:
    """(rule, key): chunks that are stored without a vector, or with one of another length."""
    size = F.size("embedding")
    wrong = F.when(F.col("embedding").isNull(), "vector missing").when(size != dimension, "vector length")
    return chunked.select(wrong.alias("rule"), F.col("id").alias("key")).where("rule is not null")

"""Whole jobs composed of the operators: ingest, question answering, its debug form, saving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GREETING, GREETING_PREVIEW, NO_CONTEXT, SETTINGS
from ..functions.text import basename, clipped, is_empty_context, is_greeting, is_refusal, retrieval_query
from ..functions.vectors import with_vectors
from ..operators.chat import TURN, prompt_messages
from ..operators.documents import replaced, vector_violations
from ..operators.plugins import generate
from ..operators.retrieval import context, hashed_topk
from ..scratch import stored
from ..sources.ingest import append, ingest_report, route_by_type, to_chunks, with_source


Embedder = Callable[[DataFrame], DataFrame]  # adds embedding to rows with content


def chunks_with_vectors(raw: DataFrame, embedder: Embedder = with_vectors, **chunking) -> DataFrame:
    """(doc_id, source, content) to chunk rows with their vectors, all in one row, so that none can be mixed up."""
    return embedder(to_chunks(raw, **chunking))


def ingest(files: DataFrame, extractors: dict[str, Callable], path: str, embedder: Embedder = with_vectors, dimension: int = SETTINGS.dimension, **chunking) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) through the extractor of their type, cut, embedded, checked and appended to ``path``.

    Gives (report of what was stored: n_documents, n_chunks; rejected files).  Chunks without a vector, or with one of
    a wrong length, stop the job before anything is stored.
    """
    texts, rejected = route_by_type(files, extractors)
    raw = texts.select(F.xxhash64("path").alias("doc_id"), basename(F.col("path")).alias("source"), "content")
    made = stored(chunks_with_vectors(raw, embedder, **chunking), "ingest")
    wrong = vector_violations(made, dimension)
    if not wrong.isEmpty():
        raise ValueError(f"{wrong.count()} chunks have no vector of length {dimension}")
    append(made, path)
    return ingest_report(made), rejected


def create_documents(raw: DataFrame, embedder: Embedder = with_vectors, **chunking) -> DataFrame:
    """Chunk rows with vectors of new documents (doc_id, source, content); a missing source is named after its row."""
    return chunks_with_vectors(with_source(raw), embedder, **chunking)


def rebuild(chunked: DataFrame, updates: DataFrame, embedder: Embedder = with_vectors, **chunking) -> DataFrame:
    """Stored chunks after the documents of ``updates`` took the place of those with their source; only new chunks are embedded.

    Without content a document's own chunks are joined and cut again; blank content changes nothing.
    """
    kept, fresh = replaced(chunked, updates, **chunking)
    return kept.unionByName(embedder(fresh))


def with_retrieval_query(queries: DataFrame) -> DataFrame:
    """(query_id, query[, history]) with the text that is looked up."""
    history = F.col("history") if "history" in queries.columns else F.lit(None).cast(TURN)
    return queries.withColumn("history", history).withColumn("search", retrieval_query(F.col("query"), F.col("history")))


def routed(queries: DataFrame, chunked: DataFrame, k: int = SETTINGS.top_k) -> DataFrame:
    """Queries with route (greeting, empty or grounded), context and sources, before any answer."""
    asked = with_retrieval_query(queries).withColumn("greeting", is_greeting(F.col("query")))
    search = asked.where("not greeting").select("query_id", F.col("search").alias("query"))
    found = context(search, hashed_topk(search, chunked, k), chunked).select("query_id", "context", "sources")
    route = F.when(F.col("greeting"), "greeting").when(is_empty_context(F.col("context")), "empty").otherwise("grounded")
    return asked.drop("search").join(found, "query_id", "left").withColumn("route", route).drop("greeting")


def finalise(answered: DataFrame) -> DataFrame:
    """(query_id, query, answer, sources, context_used, route) from routed rows with ``answer`` and ``fallback``."""
    refused = (F.col("route") == "grounded") & is_refusal(F.coalesce("answer", F.lit("")))
    grounded = (F.col("route") == "grounded") & ~refused
    none = F.slice("sources", 1, 0)
    return answered.select(
        "query_id",
        "query",
        F.when(F.col("route") == "greeting", GREETING).when(grounded, F.col("answer")).otherwise(F.col("fallback")).alias("answer"),
        F.when(grounded, F.col("sources")).otherwise(none).alias("sources"),
        grounded.alias("context_used"),
        F.when(refused, "refused").otherwise(F.col("route")).alias("route"),
    )


def answer(queries: DataFrame, chunked: DataFrame, grounded: Callable[..., str], fallback: Callable[..., str], k: int = SETTINGS.top_k, chat: bool = False) -> DataFrame:
    """Questions to answers with pluggable generators; the fallback never sees the context.

    Generators get query and context or, with ``chat``, the messages of the prompt: system, history, question.
    """
    plan = stored(routed(queries, chunked, k), "routed")  # searched once
    first = generate(_prompted(plan.where("route = 'grounded'"), True, chat), grounded).select("query_id", "answer")
    asked = stored(plan.join(first, "query_id", "left"), "answered")
    needs = asked.where((F.col("route") == "empty") | (F.col("route") == "grounded") & is_refusal(F.coalesce("answer", F.lit(""))))
    other = generate(_prompted(needs.withColumn("context", F.lit("")), False, chat), fallback).select("query_id", F.col("answer").alias("fallback"))
    return finalise(asked.join(other, "query_id", "left"))


def _prompted(plan: DataFrame, grounded: bool, chat: bool) -> DataFrame:
    history = F.coalesce("history", F.array().cast(TURN))
    return plan.withColumn("messages", prompt_messages(F.col("query"), F.col("context"), history, grounded)) if chat else plan


def debug(queries: DataFrame, chunked: DataFrame, grounded: Callable[[str, str], str], fallback: Callable[[str, str], str], k: int = SETTINGS.top_k) -> DataFrame:
    """(query_id, query, answer, fallback_used, num_docs, context_preview, documents with clipped contents and scores).

    ``queries``: (query_id, query[, history]).  A greeting gets its answer without a search and a preview that says so.
    """
    asked = with_retrieval_query(queries)
    queries = asked.select("query_id", "query")
    search = asked.where(~is_greeting(F.col("query"))).select("query_id", F.col("search").alias("query"))
    hits = stored(hashed_topk(search, chunked, k), "debug-hits")
    texts = hits.join(chunked.select("id", "content"), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "id", clipped(F.col("content"), SETTINGS.document_preview).alias("preview")))).alias("documents"))  # at most k
    found = stored(context(search, hits, chunked), "debug-context")
    route = F.when(is_greeting(F.col("query")), "greeting").when(is_empty_context(F.col("context")), "empty").otherwise("grounded")
    plan = queries.join(found.select("query_id", "context", "sources"), "query_id", "left").withColumn("route", route)
    first = stored(plan.join(generate(plan.where("route = 'grounded'"), grounded).select("query_id", "answer"), "query_id", "left"), "debug-answers")
    needs = first.where((F.col("route") == "empty") | (F.col("route") == "grounded") & is_refusal(F.coalesce("answer", F.lit(""))))
    other = generate(needs.withColumn("context", F.lit("")), fallback).select("query_id", F.col("answer").alias("fallback"))
    final = finalise(first.join(other, "query_id", "left")).select("query_id", "query", "answer", "route")
    shown = final.join(found.select("query_id", "context"), "query_id", "left").join(texts, "query_id", "left")
    preview = F.when(F.col("route") == "greeting", GREETING_PREVIEW).otherwise(clipped(F.coalesce("context", F.lit(NO_CONTEXT)), SETTINGS.context_preview))
    return shown.select("query_id", "query", "answer", F.col("route").isin("empty", "refused").alias("fallback_used"), F.coalesce(F.size("documents"), F.lit(0)).alias("num_docs"), preview.alias("context_preview"), "documents")


def prompts(plan: DataFrame) -> DataFrame:
    """Message lists of routed rows."""
    history = F.coalesce("history", F.array().cast(TURN))
    return plan.withColumn("messages", F.when(F.col("route") == "grounded", prompt_messages(F.col("query"), F.col("context"), history)).otherwise(prompt_messages(F.col("query"), F.lit(""), history, grounded=False)))

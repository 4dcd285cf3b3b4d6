"""Pluggable embedders and generators, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REFUSAL, SETTINGS
from ..functions.text import strip


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], dimension: int = SETTINGS.dimension, batch: int = SETTINGS.embed_batch, safe: bool = False) -> DataFrame:
    """``df`` with embedding and embed_error: ``embedder`` gets lists of at most ``batch`` stripped texts, order kept,
    dimensions checked.  Rows with a blank text go.

    With ``safe`` a failing batch gives null vectors and the error's text, else it fails the job.
    """
    schema = df.schema
    df = df.withColumn("_stripped", strip(F.coalesce(F.col(text), F.lit("")))).where("_stripped <> ''")

    def run(batches):
        for rows in batches:
            texts, vectors, errors = rows.column("_stripped").to_pylist(), [], []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    made = embedder(part)
                    if len(made) != len(part) or any(len(v) != dimension for v in made):
                        raise ValueError(f"embedder gave {len(made)} vectors for {len(part)} texts, or a length that is not {dimension}")
                    vectors += made
                    errors += [None] * len(part)
                except Exception as e:
                    if not safe:
                        raise
                    vectors += [None] * len(part)
                    errors += [str(e)] * len(part)
            kept = [rows.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*schema.names, "embedding", "embed_error"])

    return df.mapInArrow(run, T.StructType([*schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())]))


def generate(prompts: DataFrame, generator: Callable[..., str]) -> DataFrame:
    """(query_id, answer, status): ``generator`` gets query and context or, where ``prompts`` has ``messages``, the list of
    messages (role, content), history included; an error becomes an in-band text with status error."""
    told = ["messages"] if "messages" in prompts.columns else ["query", "context"]

    def run(batches):
        for rows in batches:
            answers, status = [], []
            for asked in zip(*(rows.column(c).to_pylist() for c in told), strict=True):
                try:
                    answers.append(generator(*asked))
                    status.append("ok")
                except Exception as e:
                    answers.append(f"[ERROR]: {e}")
                    status.append("error")
            yield pa.RecordBatch.from_arrays([rows.column("query_id"), pa.array(answers, pa.string()), pa.array(status, pa.string())], names=["query_id", "answer", "status"])

    return prompts.select("query_id", *told).mapInArrow(run, "query_id long, answer string, status string")


def extractive(query: str, context: str) -> str:
    """A deterministic stand-in for a language model: the first block that shares a word with the question, else the refusal."""
    words = set(query.lower().split())
    for block in context.split("\n\n---\n\n"):
        body = block.split("]\n", 1)[-1]
        if words & set(body.lower().split()):
            return body[:200].strip()
    return REFUSAL

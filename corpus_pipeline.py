"""The corpus pipeline: five stages applied one after another to ``documents``.

Each stage takes what its predecessor kept, decides on it and gives the columns of ``documents``
(the last one: one row per packed piece).  ``run`` writes every stage's rows as Parquet in the
shared folder and reads them again as the next one's documents.

Defined results of every stage: null text is empty and stays, but for a copy of an earlier empty text;
a row without an id is judged by its text in toxicity, exact_dedup and decontamination, and never has a
near copy; rows that repeat an id and its text stay or go together; of equal or linked documents the
smallest id stays, so there are no ties; texts are judged whole, however long; columns that are not those
of documents are dropped, whatever their names; empty documents, labels or benchmark give the rows that
the stage has no reason to drop.
"""

from __future__ import annotations

import functools

from millrace.llm.common import stored, table
from millrace.llm.decontamination import drop_contaminated
from millrace.llm.exact_dedup import drop_exact_copies
from millrace.llm.near_dedup import drop_near_copies
from millrace.llm.packing import pack_words
from millrace.llm.toxicity import drop_toxic, trained

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows of an Arrow batch: five stages share the executors, so batches of whole texts are kept small.
BATCH_ROWS = "2000"


def _stage(function):
    """The stage with Arrow batches of ``BATCH_ROWS`` rows, a setting of the session that stays for its lazy plan."""

    @functools.wraps(function)
    def run_stage(spark, docs, sf_dir):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return function(spark, docs, sf_dir)

    return run_stage


@_stage
def toxicity(spark, docs, sf_dir):
    """Documents scored 0.7 or more go; the model learns from the labelled rows that are not held out."""
    return drop_toxic(docs, trained(docs, table(spark, sf_dir, "labels"))).select(COLUMNS)


@_stage
def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the document with the smallest id stays."""
    return drop_exact_copies(docs).select(COLUMNS)


@_stage
def near_dedup(spark, docs, sf_dir):
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the one with the smallest id stays."""
    return drop_near_copies(docs, percent=80).select(COLUMNS)


@_stage
def decontamination(spark, docs, sf_dir):
    """Documents with a window like a benchmark item (0.8 or more on five-word shingles) go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


@_stage
def packing(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens, each with its sequence and offset."""
    return pack_words(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Scores, shingle hashes and vocabularies are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

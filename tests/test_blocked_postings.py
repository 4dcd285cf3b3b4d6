"""Top-k over blocked postings against the search of all vectors, and what the bounds leave out."""

import os
import uuid

import numpy as np

from millrace.operators.blocked_postings import blocked_topk, blocks_read, index_postings, pack, unpack
from millrace.operators.retrieval import hashed_topk

CHUNKS = "id string, source string, chunk_index int, content string"


def _sorted(hits):
    return sorted((r.query_id, r.rank, r.id, round(r.distance, 12)) for r in hits.collect())


def test_equals_the_search_of_all_and_skips_blocks(spark):
    """Forty topics of copies with other words at places, hits with ties, and queries of every topic."""
    rng = np.random.default_rng(3)
    rows, asked = [], []
    for topic in range(40):
        base = [f"t{topic}w{k}" for k in range(30)]
        for n in range(30):
            words = list(base)
            for at in rng.integers(0, 30, int(rng.integers(0, 4))):
                words[at] = f"x{rng.integers(0, 500)}"
            rows.append((f"{topic}-{n}", None if n % 7 == 0 else f"s{n % 3}", None if n % 11 == 0 else n, " ".join(words)))
        asked.append((topic, " ".join(base[: int(rng.integers(8, 30))])))
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, "query_id long, query string")
    index = index_postings(chunks, block_rows=8)
    assert _sorted(blocked_topk(queries, index, 5)) == _sorted(hashed_topk(queries, chunks, 5))
    read = blocks_read(queries, index, 5).collect()
    assert len(read) == 40 and sum(r.n_read for r in read) < 0.5 * sum(r.n_blocks for r in read)


def test_fewer_chunks_than_asked_for_and_rows_without_terms(spark):
    rows = [("1", "s", 0, "red fox"), ("2", "s", 1, "red fox"), ("3", None, 0, "red fox"), ("4", "a", 0, "éé"), ("5", "b", 0, None), ("6", "c", None, "")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(7, "the red fox"), (8, ""), (9, None)], "query_id long, query string")
    index = index_postings(chunks, block_rows=2)
    assert [(r[0], r[1], r[2]) for r in _sorted(blocked_topk(queries, index, 5, first=1))] == [(7, 1, "1"), (7, 2, "2"), (7, 3, "3")]
    assert blocked_topk(queries.limit(0), index).count() == 0
    assert blocked_topk(queries, index_postings(chunks.limit(0))).count() == 0


def _written(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(spark.sparkContext.getConf().get("spark.local.dir")) for f in names)


def test_index_and_search_write_less_than_the_texts(spark):
    """Texts that share most words, as those of a language do; vectors of any size are packed as they are."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"word{n}" for n in rng.zipf(1.3, 300).clip(0, 5000)) for _ in range(1500)]
    chunks = spark.createDataFrame([(str(uuid.UUID(int=i << 90)), f"s{i % 40}", i, t) for i, t in enumerate(texts)], CHUNKS)
    queries = spark.createDataFrame([(i, " ".join(t.split()[:25])) for i, t in enumerate(texts[::30])], "query_id long, query string")
    before = _written(spark)
    found = _sorted(blocked_topk(queries, index_postings(chunks), 5))
    assert _written(spark) - before < sum(map(len, texts))
    assert found == _sorted(hashed_topk(queries, chunks, 5))
    for most in (1, 127, 128, -128, 40000, 1 << 40):
        assert unpack(pack(np.array([[0, most], [1, -1]])), 2).tolist() == [[0, most], [1, -1]]

"""The bucketed store: changes by key, batches that come twice, files that stay, counts that follow; re-cut documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.vectors import with_vectors
from millrace.operators import store as S
from millrace.operators.documents import dashboard, listing, rechunk, rollup
from millrace.operators.store import DocumentStore
from millrace.sources.ingest import to_chunks

RAW = "doc_id long, source string, content string"
CHANGE = "key string, content string, source string, seq long"
ROWS = [(1, "a.txt", "one two three four"), (2, None, "alone in the world"), (3, "", "empty source"), (4, "b.txt", "bee"), (5, "c.txt", " \n ")]


@pytest.fixture
def store(spark, tmp_path):
    made = DocumentStore(spark, str(tmp_path / "store"), buckets=8, size=10, overlap=4)
    made.append(0, spark.createDataFrame(ROWS, RAW))
    return made


def agrees(store):
    chunked = store.chunks()
    assert store.dashboard().first() == dashboard(chunked).first()
    key = lambda df: sorted((r.doc_key, r.label, r.chunk_count, r.caption) for r in df.collect())
    assert key(store.listing()) == key(listing(chunked))


def contents(store, source):
    return [r.content for r in store.chunks().where(F.col("source") == source).orderBy("chunk_index").collect()]


def told(report):
    return {r.key: (r.status, r.chunks) for r in report.collect()}


def test_updates_by_key(spark, store):
    agrees(store)
    alone = [r.id for r in store.chunks().where("source is null").orderBy("chunk_index").collect()]
    second = store.chunks().where("source = 'a.txt' and chunk_index = 1").first().id
    changes = [(second.upper(), None, None, 1), (alone[0], "new text here", None, 1), ("b.txt", "  ", None, 1), ("no.txt", "x", None, 1), ("c.txt", "x", None, 1), (None, "x", None, 1)]
    got = told(store.update(1, spark.createDataFrame(changes, CHANGE)))
    assert got == {second.upper(): ("updated", 4), alone[0]: ("updated", 2), "b.txt": ("blank", 0), "no.txt": ("missing", 0), "c.txt": ("missing", 0), None: ("missing", 0)}
    joined = "one two th o three fo e four"
    assert contents(store, "a.txt") == [joined[at : at + 10].strip() for at in (0, 6, 12, 18)] and contents(store, "b.txt") == ["bee"]
    left = store.chunks().where("source is null")
    assert left.where(F.col("id") == alone[0]).isEmpty() and {r.content for r in left.collect()} >= {"new text h", "xt here"} and left.where(F.col("id").isin(alone[1:])).count() == len(alone) - 1
    agrees(store)


def test_changes_of_source_and_the_last_change_counts(spark, store):
    changes = [("a.txt", "first", None, 1), ("a.txt", "second", "z.txt", 2), ("b.txt", None, "a.txt", 1)]
    assert sorted((r.key, r.status) for r in store.update(1, spark.createDataFrame(changes, CHANGE)).collect()) == [("a.txt", "superseded"), ("a.txt", "updated"), ("b.txt", "updated")]
    assert (contents(store, "z.txt"), contents(store, "a.txt"), contents(store, "b.txt")) == (["second"], ["bee"], [])
    agrees(store)
    store.append(2, spark.createDataFrame([(9, "a.txt", "more")], RAW))
    assert sorted(contents(store, "a.txt")) == ["bee", "more"]
    agrees(store)


def test_deletions_by_key(spark, store):
    ids = {r.source: r.id for r in store.chunks().where("chunk_index = 0").collect()}
    got = told(store.delete(1, spark.createDataFrame([(ids[""],), (ids["a.txt"],), ("nope",), ("b.txt",)], "key string")))
    assert got == {ids[""]: ("deleted", 1), ids["a.txt"]: ("deleted", 3), "nope": ("missing", 0), "b.txt": ("deleted", 1)}
    assert store.chunks().where("source in ('a.txt', 'b.txt')").isEmpty() and store.chunks().where("source = ''").count() == 1
    agrees(store)
    assert told(store.delete(2, spark.createDataFrame([(ids["a.txt"],)], "key string"))) == {ids["a.txt"]: ("missing", 0)}  # ids of what is gone find nothing


def files(store):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(store.path + "/chunks") for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files_and_batches_count_once(spark, store):
    before, current = files(store), {r.f for r in store.chunks().select(F.input_file_name().alias("f")).distinct().collect()}
    change = spark.createDataFrame([("a.txt", "changed", None, 1)], CHANGE)
    first = told(store.update(1, change))
    assert {p: t for p, t in files(store).items() if p in before} == before
    after = {r.f for r in store.chunks().select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(current - after) == 1  # one bucket read and written
    known = files(store)
    assert told(store.update(1, change)) == first and files(store) == known
    store.append(0, spark.createDataFrame(ROWS, RAW))
    assert files(store) == known and store.committed() == [0, 1]
    with pytest.raises(ValueError, match="comes after"):
        DocumentStore(spark, store.path, 8).append(-1, spark.createDataFrame(ROWS, RAW))
    agrees(store)


def test_what_has_no_marker_is_not_there(spark, store, tmp_path):
    whole = sorted(store.chunks().collect())
    state = store.begun(1)
    store.write("chunks", store.chunks().withColumn("_key", F.lit("a.txt")), "_key", 1, ["id"])  # and the job is lost
    assert sorted(store.chunks().collect()) == whole and state.batch == 0
    store.append(1, spark.createDataFrame([(8, "d.txt", "dee")], RAW))
    assert contents(store, "d.txt") == ["dee"] and contents(store, "a.txt") == ["one two th", "o three fo", "e four"]
    agrees(store)


def test_only_new_chunks_are_embedded_and_compaction_keeps_rows(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    embedder = lambda df: with_vectors(df.mapInArrow(counting, df.schema), dimension=8)
    store = DocumentStore(spark, str(tmp_path), 4, embedder, size=10, overlap=4)
    store.append(0, spark.createDataFrame(ROWS, RAW))
    n = seen.value
    store.update(1, spark.createDataFrame([("b.txt", "wasp", None, 1)], CHANGE))
    assert seen.value - n <= 2  # one chunk; a plan may run once more
    rows = sorted(map(str, store.chunks().collect()))
    store.compact(2)
    assert sorted(map(str, store.chunks().collect())) == rows and all(len(r.embedding) == 8 for r in store.chunks().collect())
    assert max(len(f) for f in store.state().files.values()) == 1
    store.delete(3, store.chunks().select(F.col("id").alias("key")))
    assert store.chunks().isEmpty() and tuple(store.dashboard().first()) == (0, 0, 0) and store.listing().isEmpty()
    store.append(4, spark.createDataFrame([], RAW))
    assert store.committed() == [0, 1, 2, 3, 4]


def _disk(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(spark.sparkContext.getConf().get("spark.local.dir")) for f in names)


def test_changes_write_contents_once_more_and_do_not_shuffle_what_stays(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(2000)) for _ in range(200)]
    raw, whole = spark.createDataFrame([(i, f"{i}.txt", t) for i, t in enumerate(texts)], RAW), sum(map(len, texts))
    store = DocumentStore(spark, f"{spark.conf.get('spark.checkpoint.dir')}/{os.urandom(8).hex()}", buckets=4)
    store.append(0, raw)
    before = _disk(spark)
    changes = [(f"{i}.txt", None if i % 4 == 1 else texts[i][::-1], None, 1) for i in range(200) if i % 2]
    store.update(1, spark.createDataFrame(changes, CHANGE))
    store.delete(2, spark.createDataFrame([("0.txt",), ("2.txt",)], "key string"))
    assert _disk(spark) - before < 2.3 * whole
    assert store.dashboard().first().sources == 198
    agrees(store)


@pytest.mark.parametrize("most", [0, 1])
def test_groups_of_buckets_give_the_same_store(spark, store, tmp_path, monkeypatch, most):
    other = DocumentStore(spark, str(tmp_path / "other"), buckets=8, size=10, overlap=4)
    other.append(0, spark.createDataFrame(ROWS, RAW))
    alone = [r.id for r in store.chunks().where("source is null").orderBy("chunk_index").collect()]
    changes = spark.createDataFrame([("a.txt", None, "z.txt", 1), (alone[0], "new text here", None, 1), ("b.txt", "bumble bee", None, 1), (alone[1], None, None, 1)], CHANGE)
    gone = spark.createDataFrame([("z.txt",), (alone[2],)], "key string")
    told_by_one = [told(store.update(1, changes)), told(store.delete(2, gone))]
    monkeypatch.setattr(S, "BROADCAST_KEYS", most)
    assert [told(other.update(1, changes)), told(other.delete(2, gone))] == told_by_one
    assert sorted(map(str, other.chunks().collect())) == sorted(map(str, store.chunks().collect()))
    agrees(other)


@pytest.mark.parametrize("size, overlap", [(1, 0), (2, 0), (5, 2), (7, 9), (40, 10)])
def test_rechunk_equals_cutting_the_joined_text(spark, size, overlap):
    rng = random.Random(size)
    chunks = [(f"id{d}-{i}", f"s{d}" if d else None, rng.choice([i, i, None]), "".join(rng.choice("ab \n é😀") for _ in range(rng.choice([0, 1, 3, 30])))) for d in range(6) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(chunks, "id string, source string, chunk_index int, content string")
    whole = rollup(df.where("source is not null")).select(F.lit(0).alias("doc_id"), "source", "content")
    key = lambda rows: sorted((r.id, r.source, r.chunk_index, r.content) for r in rows.collect())
    assert key(rechunk(df, size, overlap)) == key(to_chunks(whole, size, overlap))


def test_rechunk_of_a_document_of_very_many_chunks(spark):
    n = 30_000
    df = spark.range(n).select(F.concat(F.lit("i"), F.lpad("id", 8, "0")).alias("id"), F.lit("big").alias("source"), F.col("id").cast("int").alias("chunk_index"), F.concat(F.lit("part "), "id").alias("content"))
    text = " ".join(f"part {i}" for i in range(n))
    got = {r.chunk_index: r.content for r in rechunk(df, 1800, 120).collect()}
    windows = [text[at : at + 1800].strip() for at in range(0, len(text) - 120, 1680)]
    assert [got[i] for i in range(len(got))] == windows

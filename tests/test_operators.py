"""Hand-made rows for the cases that the tables do not hold."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.config import GREETING, NEW_CHAT, NO_CONTEXT, REFUSAL
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chat as C
from millrace.operators import documents as D
from millrace.operators import plugins, retrieval
from millrace.plans import pipelines as P
from millrace.sources import ingest as S
from millrace.streaming import chat_stream as R


def column(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


def windows(text, size, overlap):
    text, out, start = " ".join(text.split()), [], 0
    while start < len(text):
        end = min(start + size, len(text))
        out += [text[start:end].strip()] if text[start:end].strip() else []
        if end == len(text):
            break
        start += max(size - overlap, 1)
    return out


@pytest.mark.parametrize("size, overlap", [(1, 0), (5, 0), (5, 2), (5, 5), (4, 9), (30, 7)])
def test_chunks(spark, size, overlap):
    rng = random.Random(size * 31 + overlap)
    texts = ["", "   ", " 　", "x", "a" * size, "a" * (size + 1), "😀 " * 9] + ["".join(rng.choice("ab \n é😀") for _ in range(rng.randrange(60))) for _ in range(60)]
    assert column(spark, lambda c: T.chunks(c, size, overlap), texts) == [windows(t, size, overlap) for t in texts]


def test_strip_and_greetings(spark):
    assert column(spark, T.strip, ["  a b　\x1c", "", " "]) == ["a b", "", ""]
    asked = ["Hi", "hello there!", "Good   morning", "HEY bot", "howdy", "hi all", "good night", ""]
    assert column(spark, T.is_greeting, asked) == [True] * 5 + [False] * 3
    assert column(spark, T.is_refusal, [REFUSAL, f" {REFUSAL}\n", REFUSAL[:-1]]) == [True, True, False]
    assert column(spark, T.title_or_default, [None, "  ", "x" * 90]) == [NEW_CHAT, NEW_CHAT, "x" * 80]
    assert column(spark, T.role_of, [" Admin ", "bob"]) == ["admin", "user"]
    assert column(spark, T.megabytes, [0, 3145728], "long") == ["0.01 MB", "3.00 MB"]


def test_hashed_vectors_follow_the_digest(spark):
    docs = spark.createDataFrame([("a", "Red fox, red FOX"), ("b", "éè"), ("c", None)], "id string, content string")
    got = {r.id: r.embedding for r in V.hashed_dense(docs, "id", "content", 16).collect()}
    want = [0.0] * 16
    for f in ["red", "fox", "red", "fox", "red fox", "fox red", "red fox"]:
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        want[h % 16] += 1 if h & 1 else -1
    length = math.sqrt(sum(x * x for x in want))
    assert got["a"] == pytest.approx([x / length for x in want], abs=1e-6)
    assert got["b"] == got["c"] == [0.0] * 16


def test_retrieval_ties_zero_vectors_and_both_ways(spark):
    chunks = spark.createDataFrame([("1", "s", 0, "red fox"), ("2", "s", 1, "red fox"), ("3", None, 0, "red fox"), ("4", "a", 0, "éé"), ("5", "b", 0, "blue whale")], "id string, source string, chunk_index int, content string")
    q = spark.createDataFrame([(7, "the red fox")], "query_id long, query string")
    fast = [(r.rank, r.id) for r in retrieval.hashed_topk(q, chunks, 5).orderBy("rank").collect()]
    assert fast == [(1, "1"), (2, "2"), (3, "3"), (4, "5"), (5, "4")]
    slow = [(r.rank, r.id) for r in retrieval.postings_topk(q, chunks, 3).orderBy("rank").collect()]
    assert slow == fast[:3]
    text = retrieval.context(q, retrieval.hashed_topk(q, chunks, 3), chunks).first()
    assert "[Source: None | Chunk: 0]\nred fox" in text.context and text.context.count("---") == 2
    assert retrieval.context(q, retrieval.hashed_topk(q, chunks.limit(0), 3), chunks).first().context == NO_CONTEXT


def test_postings_meet_without_rows_of_pairs(spark):
    """Against sums over all pairs, with pairs whose common buckets cancel out and pairs without any; nothing is joined."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    schema = "id string, source string, chunk_index int, content string"
    chunks = spark.createDataFrame([(f"i{i}", rng.choice([None, "s", "t"]), rng.choice([None, 0, 1]), t) for i, t in enumerate(texts)], schema)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", "f g e h", "zz", "", "d a"])], "query_id long, query string")
    listed = lambda df, key, text: {(r[0], r.bucket): r.weight for r in V.postings(df, key, text, 13).collect()}
    ours, theirs, place = listed(q, "query_id", "query"), listed(chunks, "id", "content"), {r.id: (r.source is None, r.source or "", r.chunk_index is None, r.chunk_index or 0) for r in chunks.collect()}
    want, length = [], lambda of, name: math.sqrt(sum(w * w for (n, _), w in of.items() if n == name))
    for a in range(6):
        dots = {}
        for (n, b), w in theirs.items():
            if (a, b) in ours:
                dots[n] = dots.get(n, 0) + w * ours[a, b]
        near = sorted((1 - dot / (length(ours, a) * length(theirs, n)), *place[n], n) for n, dot in dots.items())
        want += [(a, rank + 1, x[-1], x[0]) for rank, x in enumerate(near[:60])]
    found = retrieval.postings_topk(q, chunks, 60, 13)
    assert sorted((r.query_id, r.rank, r.id, r.distance) for r in found.collect()) == sorted(want) and any(x[-1] == 1 for x in want) and len(want) < 300
    assert "Join" not in found._jdf.queryExecution().toString()


def test_knn_zero_vector_sorts_last(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.knn(e.where("vec_id = 1"), e, 3).orderBy("rank").collect()] == [1, 3, 2]
    assert [r.vec_id for r in retrieval.knn(e.where("vec_id = 1"), e, 3, "l2").orderBy("rank").collect()] == [1, 2, 3]


def test_rollup_lookup_and_rechunk(spark):
    c = S.to_chunks(spark.createDataFrame([(1, "a.txt", "one two three four"), (2, None, "alone"), (3, "", "empty source")], "doc_id long, source string, content string"), 10, 4)
    rolled = {r.doc_key: r for r in D.rollup(c).collect()}
    assert (rolled["a.txt"].content, rolled["a.txt"].chunk_count) == ("one two th\n\no three fo\n\ne four", 3)
    assert D.dashboard(c).first().sources == 1
    one = c.where("source = 'a.txt'").first().id
    found, missing = D.resolve(spark.createDataFrame([(one,), ("a.txt",), ("nope",)], "key string"), c)
    assert found.where(F.col("key") == one).count() == rolled["a.txt"].chunk_count and [r.key for r in missing.collect()] == ["nope"]
    left, gone = D.delete(c, spark.createDataFrame([("a.txt",)], "source string"))
    assert left.where("source = 'a.txt'").count() == 0 and gone.first().deleted == rolled["a.txt"].chunk_count


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok\r\nline")
    (tmp_path / "b.txt").write_bytes(b"\x61\xff\x62")
    assert sorted(r.content for r in S.read_text_files(spark, str(tmp_path)).collect()) == ["ab", "ok\r\nline"]
    good, bad = S.read_whole_folder(spark, str(tmp_path))
    assert good.count() == bad.count() == 1
    names = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "a.txt")], "arrival long, name string")
    assert [r.stored_name for r in S.rename_collisions(names).orderBy("arrival").collect()] == ["a.txt", "a_copy.txt", "a_copy2.txt"]
    admitted = S.admit(spark.createDataFrame([("x/A.TXT",), ("b.docx",), ("c.exe",), ("",), (None,)], "path string"))
    assert [r.admitted for r in admitted.collect()] == [True, True, False, False, False]


def test_answers_and_history(spark):
    chunks = spark.createDataFrame([("1", "s", 0, "the red fox sleeps")], "id string, source string, chunk_index int, content string")
    history = [("user", "first"), ("system", "x"), ("assistant", " "), ("assistant", "second")]
    asked = spark.createDataFrame([(1, "hello there", []), (2, "where is the fox", history), (3, "quantum", None)], "query_id long, query string, history array<struct<role:string,content:string>>")
    rows = {r.query_id: r for r in P.answer(asked, chunks, plugins.extractive, lambda q, c: "general").collect()}
    assert rows[1].answer == GREETING and rows[2].answer == "the red fox sleeps" and rows[2].context_used and len(rows[2].sources) == 1
    assert (rows[3].answer, rows[3].route, rows[3].sources) == ("general", "refused", [])
    plan = P.prompts(P.routed(asked, chunks))
    assert [m.role for m in plan.where("query_id = 2").first().messages] == ["system", "user", "assistant", "user"]
    text = asked.where("query_id = 2").select(T.retrieval_query(F.col("query"), F.col("history")).alias("t")).first().t
    assert text == "Recent conversation:\nUser: first\nAssistant: second\n\nCurrent question: where is the fox"
    failing = plugins.generate(P.routed(asked, chunks).where("query_id = 2"), lambda q, c: 1 / 0).first()
    assert failing.status == "error" and failing.answer.startswith("[ERROR]: ")


def test_embedder_plugin(spark):
    df = spark.createDataFrame([("a", "x"), ("b", " yy "), ("c", " "), ("d", None)], "id string, content string")
    assert {r.id: r.embedding for r in plugins.embed(df, "content", lambda ts: [[float(len(t))] for t in ts], 1).collect()} == {"a": [1.0], "b": [2.0]}
    bad = plugins.embed(df, "content", lambda ts: [[1.0, 2.0] for _ in ts], 1, safe=True).collect()
    assert all(r.embedding is None and r.embed_error for r in bad)


def test_saving_twice_changes_nothing_more(spark):
    s = spark.createDataFrame([(1, 5, NEW_CHAT), (2, 6, "kept")], "id long, user_id long, title string").withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    m = spark.createDataFrame([(10, 1, "user", "old")], "id long, session_id long, role string, content string")
    x = spark.createDataFrame([(1, 5, 1, "q" * 90, "a"), (2, 99, 1, "not mine", "a")], "session_id long, user_id long, seq long, question string, answer string")
    s2, m2 = C.save_exchanges(s, m, x, F.timestamp_seconds(F.lit(60)))
    assert {r.id: r.title for r in s2.collect()} == {1: "q" * 80, 2: "kept"}
    assert sorted((r.id, r.role) for r in m2.collect()) == [(10, "user"), (11, "user"), (12, "assistant")]


def test_stream_fold_hides_a_refusal_until_done(spark, tmp_path):
    rows = [(1, 0, "stream", REFUSAL[:9]), (1, 1, "stream", REFUSAL[9:]), (2, 0, "stream", "hi"), (1, 2, "done", None)]
    frames = spark.createDataFrame(rows, "session_id long, seq long, type string, token string")
    frames.write.parquet(str(tmp_path / "in"))
    R.run_available(R.fold_tokens(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))), str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert [(r.session_id, r.message, r.refused) for r in got] == [(1, REFUSAL, True)]
    assert [(r.session_id, r.message) for r in R.fold_tokens_batch(frames).collect()] == [(1, REFUSAL)]


def test_constraints(spark):
    u = spark.createDataFrame([("ab",), ("abc",), ("x" * 80,), ("x" * 81,), ("Bob",), (" bob",), (None,)], "username string")
    rules = sorted((r.rule, r.key) for r in D.name_violations(u).collect())
    assert rules == [("username length", ""), ("username length", "ab"), ("username length", "x" * 81), ("username unique", "bob")]


def test_renamed_names_never_meet(spark):
    """Derived names meet names that arrive as they are and names that are stored; the first to arrive keeps a name."""
    arrivals = ["a.txt", "a_copy.txt", "a.txt", "b_copy.txt", "b.txt", "b.txt", "c.txt", "c.txt", "c_copy.txt", "c_copy.txt", "a.pdf", "d.txt", "d.txt", "d.txt"]
    names = spark.createDataFrame(list(enumerate(arrivals)), "arrival long, name string")
    old = spark.createDataFrame([("d_copy.txt",), ("e.txt",)], "name string")
    taken, want = {"d_copy.txt", "e.txt"}, []
    for name in arrivals:
        stem, ext = name.rsplit(".", 1)
        tries = (name, f"{stem}_copy.{ext}", *(f"{stem}_copy{n}.{ext}" for n in range(2, 99)))
        want.append(next(t for t in tries if t not in taken))
        taken.add(want[-1])
    assert [r.stored_name for r in S.rename_collisions(names, old).orderBy("arrival").collect()] == want
    assert S.rename_collisions(names.limit(0)).count() == 0


def test_frames_pass_over_what_is_no_turn(spark):
    said = '[{"role":"user","content":"hi"},7,{"role":"assistant","content":5},null,"x",{"role":"system","content":"s"}]'
    rows = [(1, f'{{"message":" m ","session_id":3,"history":{said}}}'), (2, '{"history":{"role":"user","content":"hi"}}'), (3, "no json")]
    got = {r.frame_id: r for r in C.parse_frames(spark.createDataFrame(rows, "frame_id long, frame string")).collect()}
    assert [(m.role, m.content) for m in got[1].history] == [("user", "hi"), ("assistant", "5")]
    assert (got[1].message, got[1].session_id, got[1].accepted) == ("m", 3, True)
    assert all((got[i].message, got[i].history, got[i].accepted) == ("", [], False) for i in (2, 3))


def test_folded_refusal_becomes_the_fallback(spark, tmp_path):
    frames = spark.createDataFrame([(1, 0, "stream", REFUSAL), (1, 1, "done", None), (2, 0, "stream", "fine"), (2, 1, "done", None)], "session_id long, seq long, type string, token string")
    frames.write.parquet(str(tmp_path / "in"))
    R.run_available(R.fold_tokens(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), "Ask me otherwise."), str(tmp_path))
    assert {r.session_id: (r.message, r.refused) for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == {1: ("Ask me otherwise.", True), 2: ("fine", False)}


def test_ingest_stores_chunks_with_vectors(spark, tmp_path):
    files = spark.createDataFrame([("in/A.txt", "one two three"), ("in/b.exe", "x"), ("in/c.txt", "  ")], "path string, content string")
    report, rejected = P.ingest(files, {"txt": lambda batches: batches}, str(tmp_path / "store"), size=8, overlap=2)
    assert (report.first().n_documents, report.first().n_chunks) == (1, 2) and [r.path for r in rejected.collect()] == ["in/b.exe"]
    store = spark.read.parquet(str(tmp_path / "store"))
    assert {(r.source, r.chunk_index, len(r.embedding)) for r in store.collect()} == {("a.txt", 0, 1024), ("a.txt", 1, 1024)}
    new = P.rebuild(store, spark.createDataFrame([(9, "a.txt", "four")], "doc_id long, source string, content string"), size=8, overlap=2)
    assert [(r.content, sum(x != 0 for x in r.embedding)) for r in new.collect()] == [("four", 1)]
    kept = P.rebuild(store, spark.createDataFrame([(9, "a.txt", " "), (9, "b.txt", None)], "doc_id long, source string, content string"), size=8, overlap=2)
    assert sorted(map(str, kept.select("id", "content").collect())) == sorted(map(str, store.select("id", "content").collect()))
    again = P.rebuild(store, spark.createDataFrame([(9, "a.txt", None)], "doc_id long, source string, content string"), size=30, overlap=2)
    assert [(r.content, len(r.embedding)) for r in again.collect()] == [("one two o three", 1024)]
    hollow = lambda df: df.withColumn("embedding", F.lit(None).cast("array<float>"))
    with pytest.raises(ValueError, match="2 chunks"):
        P.ingest(files, {"txt": lambda batches: batches}, str(tmp_path / "other"), hollow, size=8, overlap=2)


def test_stores_give_equal_texts_ids_of_their_own(spark):
    rows = spark.createDataFrame([(1, "same", {"a": "b"}), (2, "same", None)], "key long, text string, meta map<string,string>")
    got = S.build_index(rows, "key", "text", "meta", lambda df, key, text: V.with_vectors(df, text, 8)).collect()
    assert len({r.id for r in got}) == 2 and sorted(len(r.metadata) for r in got) == [0, 1] and all(len(r.embedding) == 8 for r in got)


def test_debug_of_a_greeting_and_of_a_refusal(spark):
    chunks = spark.createDataFrame([("1", "s", 0, "the red fox sleeps")], "id string, source string, chunk_index int, content string")
    asked = spark.createDataFrame([(1, "hello there"), (2, "the fox"), (3, "quantum")], "query_id long, query string")
    got = {r.query_id: r for r in P.debug(asked, chunks, plugins.extractive, lambda q, c: "general").collect()}
    assert (got[1].answer, got[1].num_docs, got[1].fallback_used) == (GREETING, 0, False) and got[1].context_preview.startswith("Greeting handled")
    assert (got[2].answer, got[2].num_docs, got[2].fallback_used) == ("the red fox sleeps", 1, False)
    assert (got[3].answer, got[3].num_docs, got[3].fallback_used) == ("general", 1, True)

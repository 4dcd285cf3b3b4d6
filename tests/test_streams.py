"""Streams against replays of the same rows: token frames, chat frames and files in any order, twice, over batches."""

import json
import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from millrace.config import NEW_CHAT, REFUSAL
from millrace.functions.vectors import with_vectors
from millrace.operators import chat as C
from millrace.operators.store import DocumentStore
from millrace.sources import ingest as S
from millrace.streaming import chat_stream as R
from millrace.streaming import file_stream as I

TOKENS = "session_id long, seq long, type string, token string"
FRAMES = "frame_id long, user_id long, seq long, frame string"


def folded(spark, batches, path):
    for rows in batches:
        spark.createDataFrame(rows, TOKENS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        R.run_available(R.fold_tokens(spark.readStream.schema(TOKENS).parquet(f"{path}/in")), path)
    return [tuple(r) for r in spark.read.parquet(f"{path}/rows").select("session_id", "message", "n_tokens", "done_seq").collect()]


def test_tokens_that_come_late_twice_and_shuffled(spark, tmp_path):
    rng, frames, want = random.Random(4), [], set()
    for s in range(20):
        seq, own = 0, []
        for _ in range(rng.randint(1, 4)):
            tokens = [rng.choice(["a", "b ", "é", ""]) for _ in range(rng.randint(0, 6))]
            own += [(s, seq + i, "stream", t) for i, t in enumerate(tokens)] + [(s, seq + len(tokens), "done", None)]
            seq += len(tokens) + 1
            want.add((s, "".join(tokens), len(tokens), seq - 1))
        lost = rng.randrange(seq) if s % 5 == 4 else seq
        frames += [f for f in own if f[1] != lost]  # nothing from a gap on is told
        want = {w for w in want if w[0] != s or w[3] < lost}
    batches = [[] for _ in range(3)]
    for f in frames:
        for _ in range(rng.choice([1, 1, 2])):
            batches[rng.randrange(3)].append(f)
    for b in batches:
        rng.shuffle(b)
    got = folded(spark, batches, str(tmp_path))
    assert len(got) == len(want) and set(got) == want
    batch = R.fold_tokens_batch(spark.createDataFrame(sum(batches, []), TOKENS))
    assert {tuple(r) for r in batch.select("session_id", "message", "n_tokens", "done_seq").collect()} == want


def test_a_token_after_done_joins_its_own_message(spark, tmp_path):
    first = [(1, 0, "stream", "a"), (1, 2, "done", None)]
    assert folded(spark, [first, [(1, 3, "stream", "c"), (1, 4, "done", None)], [(1, 1, "stream", "b"), (1, 0, "stream", "z")]], str(tmp_path)) == [(1, "ab", 2, 2), (1, "c", 1, 4)]


def test_state_that_is_kept_for_a_time(spark, tmp_path):
    spark.createDataFrame([(1, 0, "stream", "a"), (1, 1, "done", None)], TOKENS).write.parquet(f"{tmp_path}/in")
    stream = R.fold_tokens(spark.readStream.schema(TOKENS).parquet(f"{tmp_path}/in"), keep_ms=60_000)
    before = {k: spark.conf.get(k, None) for k in R.STATE}
    for k, v in R.STATE.items():
        spark.conf.set(k, v)
    query = stream.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while spark.table("kept").isEmpty() and time.time() < until:
            time.sleep(0.5)
        assert [r.message for r in spark.table("kept").collect()] == ["a"]
    finally:
        query.stop()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def chat(spark, tmp_path):
    """send(frames) -> all reply frames so far, in a world of two sessions and one chunk; answers tell the history they saw."""
    s = spark.createDataFrame([(1, 5, NEW_CHAT), (2, 6, NEW_CHAT)], "id long, user_id long, title string").withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    m = spark.createDataFrame([(100, 1, "user", "old question"), (101, 1, "system", "x")], "id long, session_id long, role string, content string")
    chunks = spark.createDataFrame([("1", "s", 0, "the red fox sleeps")], "id string, source string, chunk_index int, content string")
    path = str(tmp_path)

    def told(messages):
        query = messages[-1]["content"].rpartition("QUESTION:\n")[2]
        return REFUSAL if "quantum" in query and messages[0]["content"].count("context") else f"{query}<" + ",".join(x["content"] for x in messages[1:-1]) + ">"

    def send(rows):
        spark.createDataFrame([(*r[:3], r[3] if isinstance(r[3], str) else json.dumps(r[3])) for r in rows], FRAMES).coalesce(1).write.mode("append").parquet(f"{path}/in")
        R.chat_stream(spark.readStream.schema(FRAMES).parquet(f"{path}/in"), s, m, chunks, told, told, path, chat=True, buckets=4)
        replies = spark.read.schema("frame_id long, place int, frame string").parquet(f"{path}/replies/batch=*").orderBy("frame_id", "place").collect()
        out = {}
        for r in replies:
            out.setdefault(r.frame_id, []).append(json.loads(r.frame))
        return out

    send.sessions, send.messages, send.path = s, m, path
    return send


def test_messages_of_one_batch_see_each_other(spark, chat):
    done, stream = lambda u: {"type": "done", "user_id": str(u)}, lambda t, u: {"type": "stream", "token": t, "user_id": str(u)}
    got = chat([(4, 5, 4, {"message": "d", "session_id": 1}), (3, 5, 3, {"message": "c", "session_id": "1"}), (9, 6, 1, {"message": "z", "session_id": 2})])
    c = "c<old question>"
    d = f"d<old question,c,{c}>"
    assert got == {3: [stream(c, 5), done(5)], 4: [stream(d, 5), done(5)], 9: [stream("z<>", 6), done(6)]}
    got = chat([(10, 5, 5, {"message": "quantum", "session_id": 1}), (11, 6, 2, {"message": " ", "session_id": 2})])
    assert got[10] == [stream(f"quantum<old question,c,{c},d,{d}>", 5), done(5)] and got[11] == [{"type": "error", "message": "Message cannot be empty"}]
    saved = spark.read.schema(R.EXCHANGES).parquet(f"{chat.path}/exchanges/batch=*")
    assert sorted((r.session_id, r.seq, r.question) for r in saved.collect()) == [(1, 3, "c"), (1, 4, "d"), (1, 5, "quantum"), (2, 1, "z")]
    assert sorted(r.id for r in C.save_exchanges(chat.sessions, chat.messages, saved.where("session_id = 1"), F.timestamp_seconds(F.lit(1)))[1].collect()) == [100, 101, 106, 107, 108, 109, 110, 111]


def test_sessions_that_are_not_there_are_not_saved(chat):
    said = [{"role": "user", "content": "carried"}]
    ask = lambda session: {"message": "m", "session_id": session, "history": said}
    got = chat([(1, 5, 1, ask("x1")), (2, 9, 1, ask(1)), (3, 5, 2, ask(None)), (4, 5, 3, {"message": "m", "history": said}), (5, 5, 4, ask("")), (6, 5, 5, ask(77)), (7, 5, 6, "no json")])
    failed = {"type": "error", "message": "Unable to save chat history"}
    assert all([f.get("token") for f in got[i]] == ["m<>", None] and got[i][1] == failed for i in (1, 2, 6))
    assert all([f.get("token") for f in got[i]] == ["m<carried>", None] and got[i][1]["type"] == "done" for i in (3, 4, 5))
    assert got[7] == [{"type": "error", "message": "Message cannot be empty"}]


def test_shuffled_batches_equal_a_replay(spark, chat):
    """Sessions of so many messages that the last 12 turns cut; a replay of the last batch adds nothing."""
    rng, turns, want = random.Random(6), {1: ["old question"], 2: []}, {}
    frames, frame = [], 0
    for _ in range(15):
        session = rng.choice([1, 1, 2])
        frame += 1
        frames.append((frame, 5 if session == 1 else 6, frame, {"message": f"m{frame}", "session_id": session}))
    all_turns = {1: [("user", "old question"), ("system", "x")], 2: []}
    for f, _, _, body in frames:
        own = all_turns[body["session_id"]]
        want[f] = f"m{f}<" + ",".join(t for role, t in own[-12:] if role != "system") + ">"
        own += [("user", f"m{f}"), ("assistant", want[f])]
    for cut in (frames[:7], frames[7:]):
        rng.shuffle(cut)
        got = chat(cut)
    assert {f: x[0]["token"] for f, x in got.items()} == want
    state = R.SessionTurns(spark, f"{chat.path}/turns", 4)
    assert state.committed() == [0, 1] and state.table(state.state(), "turns").count() == sum(min(12, len(own)) for own in all_turns.values())
    shutil.rmtree(f"{chat.path}/checkpoint/commits/")  # the stream forgets that the last batch was done
    assert {f: x[0]["token"] for f, x in chat([(99, 5, 99, {"message": "m99"})]).items()} == want | {99: "m99<>"}


def test_files_that_arrive_over_batches(spark, tmp_path):
    """Five endings, names that meet, one batch run twice; the store is that of one batch over the same files."""
    folder, rng, files = tmp_path / "in", random.Random(8), []
    store = DocumentStore(spark, str(tmp_path / "store"), 4, lambda df: with_vectors(df, digest="md5"), size=40, overlap=10)
    extractors = {"txt": S.utf8_text, "pdf": S.utf8_text}
    for b in range(3):
        for i in range(12):
            name = rng.choice(["a", "A_copy", "b", "a_copy2"]) + rng.choice([".txt", ".TXT", ".pdf", ".docx", ".exe"])
            path = folder / f"{b}{i:02}" / name
            path.parent.mkdir(parents=True)
            path.write_bytes(f"file {b} {i} ".encode() * rng.randint(0, 9) + b"\xff")
            files.append(path)
            os.utime(path, (1_700_000_000 + 100 * b + i // 2,) * 2)
        I.ingest_stream(spark, f"{folder}/*", store, extractors, str(tmp_path / "state"))
    rows = sorted(map(str, store.chunks().drop("embedding").collect()))
    order = spark.createDataFrame([(n, f.name.lower()) for n, f in enumerate(files) if f.suffix.lower() in (".txt", ".pdf", ".docx")], "arrival long, name string")
    names = {r.arrival: r.stored_name for r in S.rename_collisions(order).collect()}
    raw = [(n, names[n], f.read_bytes().decode("utf-8", "ignore")) for n, f in enumerate(files) if f.suffix.lower() in (".txt", ".pdf")]
    whole = DocumentStore(spark, str(tmp_path / "whole"), 4, size=40, overlap=10)
    whole.append(0, spark.createDataFrame(raw, "n long, source string, content string").withColumn("doc_id", F.xxhash64("source")))
    assert rows == sorted(map(str, whole.chunks().collect())) and len(rows) >= 20
    assert tuple(store.dashboard().first()) == tuple(whole.dashboard().first())
    assert spark.read.schema("path string").parquet(f"{tmp_path}/state/rejected/batch=*").count() == sum(f.suffix.lower() in (".exe", ".docx") for f in files)
    last = spark.read.format("binaryFile").load([str(f) for f in files[24:]])
    I.ingest_batch(2, last, extractors, I.StoredNames(spark, f"{tmp_path}/state/names", 4), store, f"{tmp_path}/state/rejected")
    assert sorted(map(str, store.chunks().drop("embedding").collect())) == rows
    hollow = DocumentStore(spark, str(tmp_path / "hollow"), 4, lambda df: df.withColumn("embedding", F.lit(None).cast("array<float>")))
    with pytest.raises(ValueError, match="no vector"):
        I.ingest_batch(0, last, extractors, I.StoredNames(spark, f"{tmp_path}/n2", 4), hollow, f"{tmp_path}/r2")
    assert hollow.chunks().isEmpty()


def test_a_folder_embedded_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("red fox")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    rows, bad = S.embed_folder(spark, str(tmp_path), lambda df: with_vectors(df, dimension=8))
    assert [(r.content, r.source, len(r.embedding)) for r in rows.collect()] == [("red fox", None, 8)] and bad.count() == 1
    store = DocumentStore(spark, str(tmp_path / "store"), 2)
    for _ in range(2):
        store.append_chunks(0, rows.drop("embedding"))
    assert store.chunks().count() == 1 and tuple(store.dashboard().first()) == (1, 1, 0)

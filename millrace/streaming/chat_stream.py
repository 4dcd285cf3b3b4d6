"""Streams: folding tokens to messages, answering arriving messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import REFUSAL, SETTINGS
from ..operators.buckets import Buckets, State
from ..operators.chat import emit_frames, last_messages, parse_frames
from ..plans.pipelines import answer
from ..scratch import stored

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
EXCHANGES = "session_id bigint, user_id bigint, seq bigint, question string, answer string"
FOLDED = "session_id bigint, message string, n_tokens bigint, refused boolean, done_seq bigint"


class TokenFold(StatefulProcessor):
    """Tokens of a session gather by their numbers until a message is whole: its done frame has come, and every number
    from the message before it up to that frame.  Only then it goes out, so a refusal is never shown in part, and not at
    all where there is a ``fallback`` text for it.  Frames may come late, twice and in any order."""

    def __init__(self, fallback: str | None = None, keep_ms: int | None = None):
        self._fallback, self._keep = fallback, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._parts = handle.getListState("parts", "seq bigint, token string", self._keep)
        self._ends = handle.getListState("ends", "seq bigint", self._keep)
        self._next = handle.getValueState("next", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        begin = int(self._next.get()[0]) if self._next.exists() else 0
        fresh = arrived[arrived["seq"] >= begin]  # others were told already
        ends = {int(s) for s in fresh["seq"][fresh["type"] == "done"]} | ({int(r[0]) for r in self._ends.get()} if self._ends.exists() else set())
        parts = [(int(r.seq), r.token) for r in fresh[fresh["type"] == "stream"].itertuples()]
        if not ends:
            if parts:
                self._parts.appendList(parts)
            return
        tokens: dict[int, str] = {}
        for seq, token in [*(self._parts.get() if self._parts.exists() else []), *parts]:
            tokens.setdefault(int(seq), token)  # a number that comes again counts once
        out, start = [], begin
        for end in sorted(ends):
            if any(s not in tokens for s in range(begin, end)):
                break
            message = "".join(tokens.pop(s) or "" for s in range(begin, end))
            refused = message.strip() == REFUSAL
            out.append((key[0], self._fallback if refused and self._fallback is not None else message, end - begin, refused, end))
            begin = end + 1
        if begin > start:
            self._next.update((begin,))
        for state, left in ((self._ends, [(e,) for e in sorted(ends) if e >= begin]), (self._parts, sorted(tokens.items()))):
            state.put(left) if left else state.clear()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "message", "n_tokens", "refused", "done_seq"])

    def close(self) -> None:
        pass


def fold_tokens(frames: DataFrame, fallback: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, seq, type, token) to one row per finished message.

    A session numbers its frames from 0, done frames included, without gaps.  What is incomplete is forgotten ``keep_ms``
    milliseconds after it was last written, or never.
    """
    return frames.groupBy("session_id").transformWithStateInPandas(TokenFold(fallback, keep_ms), outputStructType=FOLDED, outputMode="Append", timeMode="None" if keep_ms is None else "ProcessingTime")


def fold_tokens_batch(frames: DataFrame) -> DataFrame:
    """The same over a finished table: the messages of each session up to its first gap."""
    once = frames.where("type in ('stream', 'done')").groupBy("session_id", "seq").agg(F.max(F.col("type") == "done").alias("done"), F.min(F.when(F.col("type") == "stream", F.coalesce("token", F.lit("")))).alias("token"))
    session = Window.partitionBy("session_id").orderBy("seq")
    placed = once.withColumn("place", F.row_number().over(session) - 1).where("place = seq")  # no number is missing before it
    later = session.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ended = placed.withColumn("done_seq", F.min(F.when(F.col("done"), F.col("seq"))).over(later)).where("done_seq is not null")
    parts = ended.groupBy("session_id", "done_seq").agg(F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct("seq", "token")))).alias("p"))
    message = F.array_join(F.transform("p", lambda x: x["token"]), "")
    return parts.select("session_id", message.alias("message"), F.size("p").cast("long").alias("n_tokens"), (F.trim(message) == REFUSAL).alias("refused"), "done_seq")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Process what has arrived to Parquet at ``path``/rows."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def answer_stream(messages: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Each micro-batch of (query_id, query) through ``answer``; its folder is overwritten, so a replay adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        answer(df).write.mode("overwrite").parquet(f"{path}/answers/batch={number}")

    messages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


class SessionTurns(Buckets):
    """The last messages of every session that a stream has met, in buckets by session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, buckets, {"turns": "session_id bigint, place bigint, role string, content string"})

    def of(self, state: State, asked: DataFrame, messages: DataFrame) -> tuple[DataFrame, list[int]]:
        """Last turns of the sessions in ``asked``, from ``messages`` where the stream has not met them; and their buckets."""
        ids = asked.select("session_id").where("session_id is not null").distinct()
        buckets = self.buckets_of("session_id", ids)
        met = self.table(state, "turns", buckets)
        new = ids.join(met.select("session_id").distinct(), "session_id", "left_anti")
        old = last_messages(messages.join(new, "session_id", "left_semi")).select("session_id", F.col("position").cast("long").alias("place"), "role", "content")
        return met.join(ids, "session_id", "left_semi").unionByName(old), buckets

    def save(self, batch: int, state: State, turns: DataFrame, buckets: list[int]) -> None:
        """``turns``: all of their sessions; the other sessions of the touched ``buckets`` stay."""
        kept = self.table(state, "turns", buckets).join(turns.select("session_id").distinct(), "session_id", "left_anti")
        newest = Window.partitionBy("session_id").orderBy(F.desc("place"))
        last = turns.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= SETTINGS.prompt_history).drop("_back")
        _, filled = self.write("turns", kept.unionByName(last), "session_id", batch, ["session_id"])
        self.replace(state, "turns", buckets, batch, filled)
        self.commit(batch, state)


def answer_in_order(asked: DataFrame, turns: DataFrame, answered: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(frame_id, answer) of all frames, and the turns after them, message after message inside each session.

    ``asked``: (frame_id, session_id, seq, owned, names_session, history, message).  The n-th frames of all sessions are
    answered together, so a batch takes as many rounds as its busiest session has frames.  A frame of a session that its
    user owns sees the session's turns up to the frame before; one that names no session what it carries; others nothing.
    """
    line = Window.partitionBy("session_id").orderBy("seq", "frame_id")
    placed = stored(asked.withColumn("round", F.when(F.col("owned"), F.row_number().over(line)).otherwise(1)), "chat-line")
    rounds = placed.agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
    answers = None
    for n in range(1, rounds + 1):
        here = placed.where(F.col("round") == n)
        newest = Window.partitionBy("session_id").orderBy(F.desc("place"))
        last = turns.join(here.where("owned").select("session_id"), "session_id", "left_semi").withColumn("back", F.row_number().over(newest)).where(F.col("back") <= SETTINGS.prompt_history)
        said = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "content"))).alias("turns"), F.max("place").alias("top"))  # at most 12
        own = F.transform(F.coalesce("turns", F.array().cast("array<struct<place:bigint,role:string,content:string>>")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        history = F.when(F.col("owned"), own).when(F.col("names_session"), F.slice("history", 1, 0)).otherwise(F.col("history"))
        ready = stored(here.join(said, "session_id", "left").withColumn("history", history), "chat-round")
        got = stored(answered(ready.select(F.col("frame_id").alias("query_id"), F.col("message").alias("query"), "history")).select(F.col("query_id").alias("frame_id"), "answer"), "chat-answers")
        answers = got if answers is None else answers.unionByName(got)
        top = F.coalesce("top", F.lit(0))
        pair = F.array(F.struct((top + 1).alias("place"), F.lit("user").alias("role"), F.col("message").alias("content")), F.struct((top + 2).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
        added = ready.where("owned").join(got, "frame_id").select("session_id", F.explode(pair).alias("m")).select("session_id", "m.*")
        turns = stored(turns.unionByName(added), "chat-turns")
    return (answers if answers is not None else asked.select("frame_id", F.col("message").alias("answer")).limit(0)), turns


def chat_stream(frames: DataFrame, sessions: DataFrame, messages: DataFrame, chunked: DataFrame, grounded: Callable[..., str], fallback: Callable[..., str], path: str, chat: bool = False, buckets: int = 64) -> None:
    """Arriving messages (frame_id, user_id, seq, frame) to answers and saved exchanges, batch by batch.

    Messages of a session are answered one after another, in one batch or many (:func:`answer_in_order`); its last turns
    are kept between batches.  Every question is searched and answered as a whole, so a refusal is replaced before
    anything is shown.  ``path``/replies gets (frame_id, place, frame): the answer and then a done frame, both with the
    user, or an error where the message is empty or the exchange cannot be saved, because the session is not the user's
    or has no number.  ``path``/exchanges gets what ``save_exchanges`` takes.  A batch overwrites its own folders and
    starts from the turns that the batch before left, so a replay adds nothing.
    """
    state = SessionTurns(frames.sparkSession, f"{path}/turns", buckets)

    def batch(df: DataFrame, number: int) -> None:
        before = state.begun(number)
        if before is None:
            return  # committed; its folders are whole
        asked = parse_frames(df.select("frame_id", "frame")).join(df.select("frame_id", "user_id", "seq"), "frame_id")
        owned = sessions.select(F.col("id").alias("session_id"), "user_id", F.lit(True).alias("owned"))
        ready = stored(asked.join(owned, ["session_id", "user_id"], "left").withColumn("owned", F.coalesce("owned", F.lit(False))), "chat-batch")
        good = ready.where("accepted")
        turns, touched = state.of(before, good.where("owned"), messages)
        answers, turns = answer_in_order(good, stored(turns, "chat-turns"), lambda queries: answer(queries, chunked, grounded, fallback, chat=chat))
        told = stored(good.join(answers, "frame_id"), "chat-told")
        nothing, user = F.lit(None).cast("string"), F.col("user_id").cast("string")

        def emitted(rows: DataFrame, place: int, kind: str, token=nothing, message=nothing, user_id=user) -> DataFrame:
            return rows.select("frame_id", F.lit(place).alias("place"), F.lit(kind).alias("type"), token.alias("token"), message.alias("message"), user_id.alias("user_id"))

        lost = told.where("names_session and not owned")
        out = emitted(told, 0, "stream", token=F.col("answer")).unionByName(emitted(told.where("owned or not names_session"), 1, "done"))
        out = out.unionByName(emitted(lost, 1, "error", message=F.lit("Unable to save chat history"), user_id=nothing))
        out = out.unionByName(emitted(ready.where("not accepted"), 0, "error", message=F.lit("Message cannot be empty"), user_id=nothing))
        emit_frames(out).select("frame_id", "place", "frame").write.mode("overwrite").parquet(f"{path}/replies/batch={number}")
        told.where("owned").select("session_id", "user_id", "seq", F.col("message").alias("question"), "answer").write.mode("overwrite").parquet(f"{path}/exchanges/batch={number}")
        state.save(number, before, turns, touched)

    frames.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

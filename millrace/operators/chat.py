"""Users, sessions and messages: history windows, nesting, titles, saving, deleting, registering, JSON frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FALLBACK_PROMPT, NEW_CHAT, SETTINGS, SYSTEM_PROMPT
from ..functions.text import clipped, is_blank, normal_username, role_of, spoken, strip, tail, title_or_default, user_prompt
from .running import numbered, with_ids

TURN = "array<struct<role:string,content:string>>"


def last_messages(messages: DataFrame, n: int = SETTINGS.prompt_history) -> DataFrame:
    """The last n messages of every session, with their position oldest first."""
    newest = Window.partitionBy("session_id").orderBy(F.col("id").desc())
    kept = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("id")).cast("int")).drop("_back")


def with_history(messages: DataFrame, n: int, filter_first: bool = False) -> DataFrame:
    """User turns with what was said before: the last n turns then filtered, or filtered then the last n."""
    turn = F.struct("role", "content")
    if filter_first:  # turns that count are numbered, so that a frame holds the last n of them
        good = (F.col("role").isin("user", "assistant") & ~is_blank(F.col("content"))).cast("int")
        numbered = messages.withColumn("_nth", F.coalesce(F.sum(good).over(Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        frame = Window.partitionBy("session_id").orderBy("_nth").rangeBetween(-n, -1)
        messages, history = numbered, spoken(F.collect_list(F.when(good == 1, turn)).over(frame))
    else:
        history = spoken(F.collect_list(turn).over(Window.partitionBy("session_id").orderBy("id").rowsBetween(-n, -1)))
    return messages.withColumn("history", history).where("role = 'user'").select("id", "session_id", F.col("content").alias("query"), "history")


def prompt_messages(query: Column, context: Column, history: Column, grounded: bool = True) -> Column:
    """System, history and user messages in order."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    said = spoken(tail(history, SETTINGS.prompt_history))
    head, last = (F.lit(SYSTEM_PROMPT), user_prompt(query, context)) if grounded else (F.lit(FALLBACK_PROMPT), query)
    return F.concat(F.array(message("system", head)), said, F.array(message("user", last)))


def session_detail(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their messages nested in id order; sessions without messages keep an empty list."""
    nested = messages.groupBy(F.col("session_id").alias("_session")).agg(F.array_sort(F.collect_list(F.struct("id", "role", "content"))).alias("messages"))
    return sessions.join(nested, sessions["id"] == F.col("_session"), "left").drop("_session").withColumn("messages", F.coalesce("messages", F.array().cast("array<struct<id:bigint,role:string,content:string>>")))


def sessions_of(sessions: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions of known users, sessions whose user is unknown)."""
    known = users.select(F.col("id").alias("user_id")).distinct()
    return sessions.join(known, "user_id", "left_semi"), sessions.join(known, "user_id", "left_anti")


def create_sessions(sessions: DataFrame, users: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions with the new ones, refused rows) of (arrival, user_id, title): known users only, ids go on by arrival,
    which numbers the rows from 1 without gaps; a blank title is the default one."""
    known = users.select(F.col("id").alias("user_id")).distinct()
    top = sessions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    good = wanted.join(known, "user_id", "left_semi").crossJoin(F.broadcast(top))  # one row
    new = good.select((F.col("_top") + F.col("arrival")).alias("id"), "user_id", title_or_default(F.col("title")).alias("title"), now.alias("created_at"), now.alias("updated_at"))
    return sessions.unionByName(new, allowMissingColumns=True), wanted.join(known, "user_id", "left_anti")


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) left after those of ``gone`` (user_id, session_id) that the user owns go."""
    owned = sessions.join(gone.select(F.col("session_id").alias("id"), "user_id").distinct(), ["id", "user_id"], "left_semi").select("id")
    return sessions.join(owned, "id", "left_anti"), messages.join(owned.withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def titled(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions still called by the default name take their first user message, clipped."""
    first = messages.where("role = 'user'").groupBy(F.col("session_id").alias("_session")).agg(F.min_by("content", "id").alias("_first"))
    named = sessions.join(first, sessions["id"] == F.col("_session"), "left")
    return named.withColumn("title", F.when((F.col("title") == NEW_CHAT) & F.col("_first").isNotNull(), clipped(F.col("_first"), SETTINGS.title_chars)).otherwise(F.col("title"))).drop("_session", "_first")


def save_exchanges(sessions: DataFrame, messages: DataFrame, exchanges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) after saving (session_id, user_id, seq, question, answer) rows of sessions their user owns.

    Message ids are the session's largest so far plus 2 * seq - 1 and 2 * seq, so a replay writes the same rows; a session's
    first saved question gives the default title its text.
    """
    owned = exchanges.join(sessions.select(F.col("id").alias("session_id"), "user_id"), ["session_id", "user_id"], "left_semi")
    top = messages.groupBy("session_id").agg(F.max("id").alias("top"))
    placed = owned.join(top, "session_id", "left").withColumn("top", F.coalesce("top", F.col("session_id") * 100 - 1))
    pair = F.array(F.struct((F.col("top") + 2 * F.col("seq") - 1).alias("id"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((F.col("top") + 2 * F.col("seq")).alias("id"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    added = placed.select("session_id", F.explode(pair).alias("m")).select("m.id", "session_id", "m.role", "m.content")
    touched = owned.groupBy(F.col("session_id").alias("_session")).agg(F.min_by("question", "seq").alias("_question"))
    changed = sessions.join(touched, sessions["id"] == F.col("_session"), "left")
    hit = F.col("_session").isNotNull()
    changed = changed.withColumn("title", F.when(hit & (F.col("title") == NEW_CHAT), clipped(F.col("_question"), SETTINGS.title_chars)).otherwise(F.col("title"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return changed.drop("_session", "_question"), messages.select("id", "session_id", "role", "content").unionByName(added)


def delete_users(users: DataFrame, sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left after users (id) go with their sessions and messages."""
    gone = gone.select("id").distinct()
    users = users.join(gone, "id", "left_anti")
    lost = sessions.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_semi").select(F.col("id").alias("session_id"))
    return users, sessions.join(lost.withColumnRenamed("session_id", "id"), "id", "left_anti"), messages.join(lost, "session_id", "left_anti")


def register(users: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new users, refused rows) of (arrival, username): names are normalised, unique and the first to ask wins; ids go on.

    Only newcomers are numbered, in levels.
    """
    names = wanted.withColumn("username", normal_username(F.col("username")))
    good = names.where(F.length("username").between(3, 80))
    first = good.groupBy("username").agg(F.min("arrival").alias("arrival"))
    taken = users.select(normal_username(F.col("username")).alias("username")).distinct()
    fresh = numbered(first.join(taken, "username", "left_anti"), [], ["arrival"])
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    placed = fresh.crossJoin(F.broadcast(top))  # one row
    accepted = placed.select((F.col("_top") + F.col("nth") + 1).alias("id"), "username", role_of(F.col("username")).alias("role"), "arrival")
    return accepted, names.join(accepted.select("arrival"), "arrival", "left_anti")


def parse_frames(frames: DataFrame) -> DataFrame:
    """(frame_id, message, session_id, names_session, history, accepted) from JSON text: a session may be named that has no
    number; missing message is empty, a history that is no
    list is empty; of its last items those that are no objects are passed over, content counts as text."""
    parsed = frames.withColumn("j", F.from_json("frame", "message string, session_id string, history string"))
    items = F.when(strip(F.col("j.history")).startswith("["), F.from_json(F.col("j.history"), "array<string>"))
    objects = F.filter(tail(items, SETTINGS.prompt_history), lambda x: x.startswith("{"))
    fields = F.transform(objects, lambda x: F.from_json(x, "map<string,string>"))
    content = lambda m: F.when(F.map_contains_key(m, F.lit("content")), F.coalesce(m["content"], F.lit("None"))).otherwise("")
    turns = F.transform(fields, lambda m: F.struct(m["role"].alias("role"), content(m).alias("content")))
    message = strip(F.coalesce(F.col("j.message"), F.lit("")))
    names = F.coalesce(~F.col("j.session_id").isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False))
    return parsed.select("frame_id", message.alias("message"), F.expr("try_cast(j.session_id as bigint)").alias("session_id"), names.alias("names_session"), spoken(F.coalesce(turns, F.array().cast(TURN))).alias("history"), (message != "").alias("accepted"))


def emit_frames(rows: DataFrame) -> DataFrame:
    """JSON frames of (type, token, message[, user_id]); null fields are left out."""
    return rows.withColumn("frame", F.to_json(F.struct("type", "token", "message", *(c for c in ("user_id",) if c in rows.columns))))


def additive_columns(table: DataFrame, columns: dict[str, Column], ids_by: list[str] | None = None) -> DataFrame:
    """Columns that are missing are added with their default; existing ones stay.  With ``ids_by``, rows without an id
    get the next ones, in that order."""
    if ids_by:
        table = with_ids(table, ids_by)
    return table.withColumns({name: default for name, default in columns.items() if name not in table.columns})


def next_id(table: DataFrame) -> DataFrame:
    return table.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))

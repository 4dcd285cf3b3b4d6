"""Queries on retrieval, answers, users, sessions, messages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FALLBACK_PROMPT, GREETING, GREETING_PATTERN, NO_CONTEXT, REFUSAL, SYSTEM_PROMPT
from ..functions.text import daypart, is_greeting, normal_username, retrieval_query, role_of
from ..operators import chat as C
from ..operators.plugins import extractive, generate
from ..operators.blocked_postings import blocked_topk, index_postings
from ..operators.retrieval import context, hashed_topk, hashed_vectors, postings_topk
from ..plans import pipelines as P
from ..scratch import folder, stored
from ..sources import ingest as S
from ..streaming import chat_stream as R
from .fixtures import MESSAGES_SQL, RAW_SQL, SESSIONS_SQL, USERS_SQL, chunk_table, chunks_sql, messages, postings_sql, questions, sessions, strip_sql, table, token_stream, users

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Retrieval and answers ------------------------------------------------------------------------------------------------

_QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_TOPK_SQL = f"""WITH {RAW_SQL}, {chunks_sql()}, {_QUESTIONS_SQL}, {postings_sql('p', 'id', 'content', 'chunks')}, {postings_sql('q', 'query_id', 'query', 'questions')},
pn AS (SELECT id, CAST(sum(weight * weight) AS BIGINT) AS n2 FROM p GROUP BY id), qn AS (SELECT query_id, CAST(sum(weight * weight) AS BIGINT) AS n2 FROM q GROUP BY query_id),
dots AS (SELECT q.query_id, p.id, CAST(sum(q.weight * p.weight) AS BIGINT) AS dot FROM q JOIN p USING (bucket) GROUP BY ALL),
d AS (SELECT query_id, id, 1 - dot / (sqrt(qn.n2) * sqrt(pn.n2)) AS distance FROM dots JOIN qn USING (query_id) JOIN pn USING (id)),
r AS (SELECT d.*, c.source, c.chunk_index, c.content, row_number() OVER (PARTITION BY query_id ORDER BY distance, c.source NULLS LAST, chunk_index NULLS LAST, id) AS rank FROM d JOIN chunks c USING (id)),
hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, distance, id, source, chunk_index, content FROM r WHERE rank <= 5)"""
_CONTEXT_SQL = f"""{_TOPK_SQL},
contexts AS (SELECT q.query_id, q.query, coalesce(string_agg('[Source: ' || coalesce(source, 'None') || ' | Chunk: ' || coalesce(CAST(chunk_index AS VARCHAR), 'None') || ']' || chr(10) || {strip_sql('content')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '{NO_CONTEXT}') AS context, count(id) AS num_docs
FROM questions q LEFT JOIN hits USING (query_id) GROUP BY ALL)"""


def _hits(spark, sf_dir):
    return hashed_topk(questions(spark, sf_dir), chunk_table(spark, sf_dir))


@query(f"{_TOPK_SQL} SELECT query_id, rank, distance, id, source, chunk_index FROM hits")
def retrieve_hashed_topk(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"{_TOPK_SQL} SELECT query_id, rank, distance, id, source, chunk_index FROM hits")
def retrieve_postings_topk(spark, sf_dir):
    return postings_topk(questions(spark, sf_dir), chunk_table(spark, sf_dir))


@query(f"{_CONTEXT_SQL} SELECT query_id, query, context FROM contexts")
def retrieve_hashed_context(spark, sf_dir):
    return context(questions(spark, sf_dir), _hits(spark, sf_dir), chunk_table(spark, sf_dir)).drop("sources")


@query(f"""{_CONTEXT_SQL}, shown AS (SELECT query_id, query, num_docs, substr(context, 1, 500) AS context_preview, (SELECT string_agg(substr(h.content, 1, 200), '|' ORDER BY h.rank) FROM hits h WHERE h.query_id = contexts.query_id) AS previews, length(query) % 3 = 0 AS refused FROM contexts)
SELECT query_id, num_docs, context_preview, previews, CASE WHEN refused THEN 'I cannot say: ' || query ELSE 'found: ' || query END AS answer, refused AS fallback_used FROM shown""")
def debug_answer(spark, sf_dir):
    """A stand-in generator refuses every question whose length is a multiple of three."""
    d = P.debug(questions(spark, sf_dir), chunk_table(spark, sf_dir), lambda q, _: REFUSAL if len(q) % 3 == 0 else f"found: {q}", lambda q, _: f"I cannot say: {q}")
    return d.select("query_id", F.col("num_docs").cast("long").alias("num_docs"), "context_preview", F.array_join(F.transform("documents", lambda x: x["preview"]), "|").alias("previews"), "answer", "fallback_used")


@query(f"{_TOPK_SQL} SELECT query_id, rank, distance, id, source, chunk_index FROM hits")
def retrieve_stored_topk(spark, sf_dir):
    """The search over vectors that were made and stored once."""
    return hashed_topk(questions(spark, sf_dir), stored(hashed_vectors(chunk_table(spark, sf_dir)), "stored-vectors"))


@query(f"{_TOPK_SQL} SELECT query_id, rank, distance, id, source, chunk_index FROM hits")
def retrieve_blocked_topk(spark, sf_dir):
    """The search over stored postings in blocks, of which bounds rule some out."""
    return blocked_topk(questions(spark, sf_dir), index_postings(chunk_table(spark, sf_dir)))


def _asked(spark, sf_dir):
    """Every conversation turn as a question; each opening turn becomes a greeting."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.when(F.col("turn") == 0, F.element_at(F.array(F.lit("Hello there!"), F.lit("Good   morning"), F.lit("HEY, bot"), F.lit("hi all"), F.lit("good night"), F.lit("howdy")), (F.col("conv_id") % 6 + 1).cast("int"))).otherwise(F.col("text")).alias("query"))


_ASKED_SQL = "asked AS (SELECT conv_id * 100 + turn AS query_id, CASE WHEN turn = 0 THEN (['Hello there!', 'Good   morning', 'HEY, bot', 'hi all', 'good night', 'howdy'])[conv_id % 6 + 1] ELSE text END AS query FROM conversations)"
_GREETING_SQL = rf"regexp_matches(trim(regexp_replace(regexp_replace(lower(query), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')), '{GREETING_PATTERN}')"


@query(f"WITH {_ASKED_SQL} SELECT query_id, query, {_GREETING_SQL} AS greeting FROM asked")
def greeting_route(spark, sf_dir):
    return _asked(spark, sf_dir).withColumn("greeting", is_greeting(F.col("query")))


@query(f"""{_CONTEXT_SQL}, best AS (SELECT query_id, substr(content, 1, 100) AS lead, distance FROM hits WHERE rank = 1)
SELECT query_id, query, CASE WHEN distance < 0.6 THEN lead ELSE 'I cannot say: ' || query END AS answer, distance < 0.6 AS context_used, CASE WHEN distance < 0.6 THEN 'grounded' ELSE 'refused' END AS route, CASE WHEN distance < 0.6 THEN num_docs ELSE 0 END AS n_sources
FROM contexts JOIN best USING (query_id)""")
def answer_route(spark, sf_dir):
    """Answers from a stub: the start of the nearest chunk, or the refusal where it is far."""
    chunked, asked = chunk_table(spark, sf_dir), questions(spark, sf_dir)
    best = _hits(spark, sf_dir).where("rank = 1").join(chunked.select("id", "content"), "id").select("query_id", F.when(F.col("distance") < 0.6, F.substring("content", 1, 100)).otherwise(REFUSAL).alias("answer"))
    answered = P.routed(asked, chunked).join(best, "query_id", "left").withColumn("fallback", F.concat(F.lit("I cannot say: "), "query"))
    return P.finalise(answered).select("query_id", "query", "answer", "context_used", "route", F.size("sources").cast("long").alias("n_sources"))


@query()
def generate_stub(spark, sf_dir):
    """The whole pipeline with pluggable generators."""
    return P.answer(questions(spark, sf_dir), chunk_table(spark, sf_dir), extractive, lambda q, _: f"I cannot say: {q}").select("query_id", "answer", "context_used", "route")


# History and prompts --------------------------------------------------------------------------------------------------

_GOOD_SQL = "role IN ('user', 'assistant') AND " + strip_sql("content") + " <> ''"
_LINE_SQL = "CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(" + strip_sql("content") + ", 1, 500)"


@query(f"WITH {MESSAGES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM messages) SELECT id, session_id, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY id) AS INTEGER) AS position FROM n WHERE back <= 3")
def history_last12(spark, sf_dir):
    """The last messages per session, here 3, as conversations are short."""
    return C.last_messages(messages(spark, sf_dir), 3)


def _said_sql(filtered_first: bool) -> str:
    good = _GOOD_SQL
    where = f"WHERE {good}"
    return f"""WITH {MESSAGES_SQL}, u AS (SELECT id AS uid, session_id, content AS query FROM messages WHERE role = 'user'), m AS (SELECT * FROM messages {where if filtered_first else ''}),
b AS (SELECT u.uid, m.*, row_number() OVER (PARTITION BY u.uid ORDER BY m.id DESC) AS back FROM u JOIN m ON m.session_id = u.session_id AND m.id < u.uid),
s AS (SELECT uid, string_agg({_LINE_SQL}, chr(10) ORDER BY id) AS said, count(*) AS n FROM b WHERE back <= 3 AND {good} GROUP BY uid)
SELECT u.uid AS id, u.session_id, coalesce(s.n, 0) AS n_history, coalesce(s.said, '') AS said FROM u LEFT JOIN s USING (uid)"""


def _said(spark, sf_dir, filter_first):
    from ..functions.text import history_text

    return C.with_history(messages(spark, sf_dir), 3, filter_first).select("id", "session_id", F.size("history").cast("long").alias("n_history"), history_text(F.col("history")).alias("said"))


@query(_said_sql(False))
def history_tail8_then_filter(spark, sf_dir):
    """Tail, then filter; a tail of 3, so that it cuts."""
    return _said(spark, sf_dir, False)


@query(_said_sql(True))
def history_filter_then_tail12(spark, sf_dir):
    """Filter, then tail; a tail of 3, so that it cuts."""
    return _said(spark, sf_dir, True)


_LOOKED_SQL = f"looked AS (SELECT id, CASE WHEN said = '' THEN query ELSE 'Recent conversation:' || chr(10) || said || chr(10) || chr(10) || 'Current question: ' || query END AS search, said, query FROM (SELECT h.id, h.said, m.content AS query FROM ({_said_sql(False)}) h JOIN (SELECT conv_id * 100 + turn AS id, text AS content FROM conversations) m USING (id)))"


@query(f"WITH {_LOOKED_SQL} SELECT id, search FROM looked")
def retrieval_query_text(spark, sf_dir):
    h = C.with_history(messages(spark, sf_dir), 3)
    return h.select("id", retrieval_query(F.col("query"), F.col("history")).alias("search"))


@query(f"""WITH {MESSAGES_SQL}, u AS (SELECT id AS uid, session_id, content AS query FROM messages WHERE role = 'user'),
b AS (SELECT u.uid, m.*, row_number() OVER (PARTITION BY u.uid ORDER BY m.id DESC) AS back FROM u JOIN messages m ON m.session_id = u.session_id AND m.id < u.uid),
s AS (SELECT uid, string_agg(role || '=' || {strip_sql('content')}, chr(10) ORDER BY id) AS said, count(*) AS n FROM b WHERE back <= 3 AND {_GOOD_SQL} GROUP BY uid)
SELECT u.uid AS id, coalesce(s.n, 0) + 2 AS n_messages, 'system=' || {_quoted(SYSTEM_PROMPT)} || chr(10) || coalesce(s.said || chr(10), '') || 'user=' || {strip_sql("'CONTEXT:' || chr(10) || '" + NO_CONTEXT + "' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || query")} AS flat,
'system=' || {_quoted(FALLBACK_PROMPT)} || chr(10) || coalesce(s.said || chr(10), '') || 'user=' || query AS flat_fallback
FROM u LEFT JOIN s USING (uid)""")
def prompt_messages(spark, sf_dir):
    h = C.with_history(messages(spark, sf_dir), 3)
    flat = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("="), x["content"])), "\n")
    grounded = C.prompt_messages(F.col("query"), F.lit(NO_CONTEXT), F.col("history"))
    return h.select("id", F.size(grounded).cast("long").alias("n_messages"), flat(grounded).alias("flat"), flat(C.prompt_messages(F.col("query"), F.lit(""), F.col("history"), grounded=False)).alias("flat_fallback"))


# Sessions and users ---------------------------------------------------------------------------------------------------


@query(f"WITH {SESSIONS_SQL} SELECT id, user_id, title, updated_s, row_number() OVER (PARTITION BY user_id ORDER BY updated_s DESC, id DESC) AS position FROM sessions")
def session_list(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    return sessions(spark, sf_dir).select("id", "user_id", "title", F.unix_timestamp("updated_at").alias("updated_s"), F.row_number().over(order).cast("long").alias("position"))


@query(f"WITH {SESSIONS_SQL}, {MESSAGES_SQL} SELECT s.id, s.user_id, count(m.id) AS n_messages, coalesce(string_agg(m.role || ':' || m.content, chr(10) ORDER BY m.id), '') AS flat FROM sessions s LEFT JOIN messages m ON m.session_id = s.id GROUP BY ALL")
def session_detail(spark, sf_dir):
    d = C.session_detail(sessions(spark, sf_dir), messages(spark, sf_dir))
    return d.select("id", "user_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("flat"))


_TITLES_SQL = f"WITH {SESSIONS_SQL}, {MESSAGES_SQL}, f AS (SELECT session_id, substr(arg_min(content, id), 1, 80) AS first FROM messages WHERE role = 'user' GROUP BY session_id)"


@query(f"{_TITLES_SQL} SELECT s.id, coalesce(f.first, s.title) AS title FROM sessions s LEFT JOIN f ON f.session_id = s.id")
def session_titles(spark, sf_dir):
    return C.titled(sessions(spark, sf_dir), messages(spark, sf_dir)).select("id", "title")


def _saved(spark, sf_dir):
    """Two exchanges for every session, one of them by a user who does not own it."""
    s = sessions(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("seq"), F.lit(0).alias("shift")), F.struct(F.lit(2).cast("long").alias("seq"), (F.col("id") % 2).cast("int").alias("shift")))).alias("e")
    x = s.select(F.col("id").alias("session_id"), "user_id", both).select("session_id", (F.col("user_id") + F.col("e.shift")).alias("user_id"), F.col("e.seq").alias("seq"), F.concat(F.lit("question "), F.col("e.seq").cast("string")).alias("question"), F.concat(F.lit("answer "), F.col("e.seq").cast("string")).alias("answer"))
    return C.save_exchanges(s, messages(spark, sf_dir), x, F.timestamp_seconds(F.lit(1735689600)))


@query(f"""WITH {SESSIONS_SQL}, {MESSAGES_SQL}, top AS (SELECT s.id AS session_id, coalesce(max(m.id), s.id * 100 - 1) AS top FROM sessions s LEFT JOIN messages m ON m.session_id = s.id GROUP BY s.id),
x AS (SELECT session_id, top, seq FROM top, (VALUES (1), (2)) t(seq) WHERE seq = 1 OR session_id % 2 = 0),
a AS (SELECT id, session_id, role, content FROM messages UNION ALL SELECT top + 2 * seq - 1, session_id, 'user', 'question ' || seq FROM x UNION ALL SELECT top + 2 * seq, session_id, 'assistant', 'answer ' || seq FROM x)
SELECT s.id, 'question 1' AS title, CAST(1735689600 AS BIGINT) AS updated_s, count(*) AS n_messages, max(a.id) AS last_id FROM sessions s JOIN a ON a.session_id = s.id GROUP BY s.id""")
def save_exchange(spark, sf_dir):
    s, m = _saved(spark, sf_dir)
    n = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("id").alias("last_id"))
    return s.join(n, s["id"] == n["session_id"]).select("id", "title", F.unix_timestamp("updated_at").alias("updated_s"), "n_messages", "last_id")


@query(f"WITH {SESSIONS_SQL}, {MESSAGES_SQL}, {USERS_SQL}, gone AS (SELECT id FROM users WHERE username LIKE '%7'), ls AS (SELECT id FROM sessions WHERE user_id NOT IN (SELECT id FROM gone)) SELECT 'users' AS kind, id FROM users WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'sessions', id FROM ls UNION ALL SELECT 'messages', id FROM messages WHERE session_id IN (SELECT id FROM ls)")
def delete_cascade(spark, sf_dir):
    u = users(spark, sf_dir)
    left = C.delete_users(u, sessions(spark, sf_dir), messages(spark, sf_dir), u.where("username like '%7'"))
    parts = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in zip(("users", "sessions", "messages"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {SESSIONS_SQL}, {USERS_SQL}, wanted AS (SELECT c_custkey + 1 AS arrival, CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS user_id, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN c_name || ' asks' END AS title FROM customer)
SELECT (SELECT max(id) FROM sessions) + arrival AS id, user_id, coalesce(title, 'New chat') AS title, true AS created FROM (SELECT arrival, user_id, nullif(trim(title), '') AS title FROM wanted) WHERE user_id IN (SELECT id FROM users)
UNION ALL SELECT id, user_id, title, false FROM sessions UNION ALL SELECT NULL, user_id, title, false FROM wanted WHERE user_id NOT IN (SELECT id FROM users)""")
def create_sessions(spark, sf_dir):
    """New sessions of customers, some unknown, some without a title."""
    customers = table(spark, sf_dir, "customer")
    wanted = customers.select((F.col("c_custkey") + 1).alias("arrival"), F.when(F.col("c_custkey") % 5 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit(" asks"))).alias("title"))
    old = sessions(spark, sf_dir)
    made, refused = C.create_sessions(old, users(spark, sf_dir), wanted, F.timestamp_seconds(F.lit(1735689600)))
    made = made.select("id", "user_id", "title", (F.col("created_at") == F.timestamp_seconds(F.lit(1735689600))).alias("created"))
    return made.unionByName(refused.select(F.lit(None).cast("long").alias("id"), "user_id", "title", F.lit(False).alias("created")))


@query(f"WITH {SESSIONS_SQL}, {MESSAGES_SQL}, gone AS (SELECT id FROM sessions WHERE id % 3 = 0) SELECT 'sessions' AS kind, id FROM sessions WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'messages', id FROM messages WHERE session_id NOT IN (SELECT id FROM gone)")
def delete_sessions(spark, sf_dir):
    """Every third session goes with its messages; for others a user asks who does not own them."""
    s = sessions(spark, sf_dir)
    gone = s.where("id % 3 < 2").select(F.col("id").alias("session_id"), (F.col("user_id") + F.col("id") % 3).alias("user_id"))
    left, kept = C.delete_sessions(s, messages(spark, sf_dir), gone)
    return left.select(F.lit("sessions").alias("kind"), "id").unionByName(kept.select(F.lit("messages").alias("kind"), "id"))


@query(f"WITH {SESSIONS_SQL}, {USERS_SQL} SELECT id, user_id, user_id IN (SELECT id FROM users) AS known FROM (SELECT id, CASE WHEN id % 7 = 0 THEN -1 ELSE user_id END AS user_id FROM sessions)")
def session_owners(spark, sf_dir):
    s = sessions(spark, sf_dir).withColumn("user_id", F.when(F.col("id") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))
    known, unknown = C.sessions_of(s, users(spark, sf_dir))
    return known.select("id", "user_id", F.lit(True).alias("known")).unionByName(unknown.select("id", "user_id", F.lit(False).alias("known")))


@query("SELECT c_custkey AS id, lower(trim(n)) AS username, CASE WHEN lower(trim(n)) = 'admin' THEN 'admin' ELSE 'user' END AS role FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN '  ADMIN ' ELSE c_name END AS n FROM customer)")
def user_roles(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("n", F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 3), "  ADMIN ").otherwise(F.col("c_name")))
    return c.select(F.col("c_custkey").alias("id"), normal_username(F.col("n")).alias("username"), role_of(F.col("n")).alias("role"))


@query(f"WITH {USERS_SQL}, asked AS (SELECT DISTINCT '  ' || upper(username) || ' ' AS login FROM users UNION SELECT lang FROM documents) SELECT a.login, u.id FROM asked a LEFT JOIN users u ON lower(u.username) = lower(trim(a.login))")
def user_lookup(spark, sf_dir):
    u = users(spark, sf_dir)
    asked = u.select(F.concat(F.lit("  "), F.upper("username"), F.lit(" ")).alias("login")).union(table(spark, sf_dir, "documents").select("lang")).distinct()
    return asked.join(u, F.lower(u["username"]) == normal_username(asked["login"]), "left").select("login", "id")


@query(f"""WITH {USERS_SQL}, wanted AS (SELECT doc_id AS arrival, CASE WHEN doc_id % 3 = 0 THEN ' Customer#' || lpad(CAST(doc_id AS VARCHAR), 9, '0') WHEN doc_id % 3 = 1 THEN upper(source) || ' ' || lang ELSE lang END AS username FROM documents),
n AS (SELECT arrival, lower(trim(username)) AS username FROM wanted), f AS (SELECT username, min(arrival) AS arrival FROM n WHERE length(username) BETWEEN 3 AND 80 GROUP BY username),
g AS (SELECT * FROM f WHERE username NOT IN (SELECT lower(trim(username)) FROM users))
SELECT n.arrival, n.username, (SELECT max(id) FROM users) + r.nth AS id, r.nth IS NOT NULL AS accepted FROM n LEFT JOIN (SELECT arrival, row_number() OVER (ORDER BY arrival) AS nth FROM g) r USING (arrival)""")
def register_users(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))).when(F.col("doc_id") % 3 == 1, F.concat(F.upper("source"), F.lit(" "), "lang")).otherwise(F.col("lang"))
    good, refused = C.register(users(spark, sf_dir), d.select(F.col("doc_id").alias("arrival"), name.alias("username")))
    return good.select("arrival", "username", "id", F.lit(True).alias("accepted")).unionByName(refused.select("arrival", "username", F.lit(None).cast("long").alias("id"), F.lit(False).alias("accepted")))


@query(f"WITH {USERS_SQL}, {MESSAGES_SQL} SELECT 'users' AS kind, coalesce(max(id), 0) + 1 AS next_id FROM users UNION ALL SELECT 'messages', coalesce(max(id), 0) + 1 FROM messages")
def next_ids(spark, sf_dir):
    return C.next_id(users(spark, sf_dir)).select(F.lit("users").alias("kind"), "next_id").unionByName(C.next_id(messages(spark, sf_dir)).select(F.lit("messages").alias("kind"), "next_id"))


@query(f"WITH {USERS_SQL} SELECT id, username, 'user' AS role, id * 2 AS score FROM users")
def evolve_columns(spark, sf_dir):
    return C.additive_columns(users(spark, sf_dir), {"username": F.lit("none"), "role": F.lit("user"), "score": F.col("id") * 2})


@query("SELECT CASE WHEN turn % 3 = 0 THEN 1000 + conv_id * 100 + turn ELSE (SELECT max(1000 + conv_id * 100 + turn) FROM conversations WHERE turn % 3 = 0) + row_number() OVER (PARTITION BY turn % 3 = 0 ORDER BY conv_id, turn) END AS id, conv_id, turn, 'user' AS kind FROM conversations")
def fill_ids(spark, sf_dir):
    """An old table two thirds of whose rows have no id yet: they get the next ones, in order, without a gap."""
    c = table(spark, sf_dir, "conversations")
    old = c.select(F.when(F.col("turn") % 3 == 0, 1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn")
    return C.additive_columns(old, {"id": F.lit(0), "kind": F.lit("user")}, ids_by=["conv_id", "turn"])


# Times, frames and streams --------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END AS part FROM events")
def daypart_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", daypart(F.col("ts")).alias("part"))


@query(f"WITH {SESSIONS_SQL} SELECT id, strftime(to_timestamp(updated_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM sessions")
def session_dates(spark, sf_dir):
    return sessions(spark, sf_dir).select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query(f"""WITH c AS (SELECT *, {strip_sql('text')} AS t FROM conversations), n AS (SELECT *, role IN ('user', 'assistant') AND t <> '' AS said FROM c)
SELECT conv_id * 100 + turn AS frame_id, CASE WHEN turn % 5 = 4 THEN '' ELSE t END AS message, CASE WHEN turn % 3 = 1 THEN NULL ELSE conv_id END AS session_id, turn % 5 <> 4 AND t <> '' AS accepted,
CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN said THEN role || '=' || t ELSE '' END WHEN 2 THEN '' ELSE CASE WHEN said THEN role || '=' || t || '|' ELSE '' END || 'assistant=5|user=None' END AS said
FROM n""")
def parse_frames(spark, sf_dir):
    """JSON frames made from turns: messages that are missing, session ids that are no numbers, histories that are no lists
    or hold numbers, texts, nulls and lists among their objects."""
    c = table(spark, sf_dir, "conversations")
    quoted = lambda text: F.regexp_extract(F.to_json(F.struct(text.alias("m"))), r'(?s)^\{"m":(.*)\}$', 1)
    turn = F.concat(F.lit('{"role":'), quoted(F.col("role")), F.lit(',"content":'), quoted(F.col("text")), F.lit("}"))
    mixed = F.concat(F.lit('[7,"x",'), turn, F.lit(',null,{"role":"system","content":"s"},[1,2],{"role":"assistant","content":5},{"role":"user"},{"role":"user","content":null},true]'))
    history = F.when(F.col("turn") % 4 == 0, F.lit('"none"')).when(F.col("turn") % 4 == 1, F.concat(F.lit("["), turn, F.lit("]"))).when(F.col("turn") % 4 == 2, turn).otherwise(mixed)
    message = F.when(F.col("turn") % 5 != 4, F.concat(F.lit('"message":'), quoted(F.col("text")), F.lit(","))).otherwise("")
    session = F.when(F.col("turn") % 3 == 1, F.lit('"x1"')).otherwise(F.col("conv_id").cast("string"))
    frames = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("frame_id"), F.concat(F.lit("{"), message, F.lit('"session_id":'), session, F.lit(',"history":'), history, F.lit("}")).alias("frame"))
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    return C.parse_frames(frames).select("frame_id", "message", "session_id", "accepted", said.alias("said"))


@query("SELECT conv_id * 100 + turn AS id, CASE role WHEN 'assistant' THEN 'stream' WHEN 'user' THEN 'done' ELSE 'error' END AS type, CASE role WHEN 'assistant' THEN text END AS token, CASE WHEN role = 'system' THEN text END AS message FROM conversations")
def emit_frames(spark, sf_dir):
    """Frames written as JSON and read back."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "stream").when(F.col("role") == "user", "done").otherwise("error")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), kind.alias("type"), F.when(F.col("role") == "assistant", F.col("text")).alias("token"), F.when(F.col("role") == "system", F.col("text")).alias("message"))
    return C.emit_frames(rows).select("id", F.from_json("frame", "type string, token string, message string").alias("f")).select("id", "f.type", "f.token", "f.message")


_FOLD_SQL = f"SELECT conv_id * 100 + turn AS session_id, text AS message, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens, trim(text) = {_quoted(REFUSAL)} AS refused FROM conversations WHERE role = 'assistant'"


@query(_FOLD_SQL)
def token_stream_fold(spark, sf_dir):
    """Token frames through the stateful stream."""
    path = folder(spark, "token-fold")
    token_stream(spark, sf_dir).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("session_id bigint, seq bigint, type string, token string").parquet(f"{path}/in")
    R.run_available(R.fold_tokens(stream), path)
    return spark.read.schema(R.FOLDED).parquet(f"{path}/rows").drop("done_seq")


@query(f"""WITH {MESSAGES_SQL}, {SESSIONS_SQL}, asked AS (SELECT conv_id * 100 + turn AS frame_id, conv_id, turn, {strip_sql('text')} AS t FROM conversations WHERE role = 'user')
SELECT frame_id, CASE WHEN turn % 4 = 2 THEN 'error' ELSE 'stream' END AS type, CASE WHEN turn % 4 <> 2 THEN CASE WHEN length(t) % 2 = 0 THEN 'found: ' ELSE 'I cannot say: ' END || t END AS token, CASE WHEN turn % 4 = 2 THEN 'Message cannot be empty' END AS message,
turn % 4 <> 2 AND conv_id % 2 = 0 AS saved FROM asked""")
def chat_stream(spark, sf_dir):
    """User turns as frames of one stream: searched, answered, replaced where refused, saved for those who own the session."""
    path = folder(spark, "chat-stream")
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    body = F.to_json(F.struct(F.when(F.col("turn") % 4 == 2, " ").otherwise(F.col("text")).alias("message"), F.col("conv_id").cast("string").alias("session_id")))
    sent = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("frame_id"), (F.col("conv_id") % 50 + F.col("conv_id") % 2).alias("user_id"), F.col("turn").cast("long").alias("seq"), body.alias("frame"))
    sent.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(sent.schema).parquet(f"{path}/in")
    chunks = S.to_chunks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("b").alias("source"), F.col("text").alias("content")))
    R.chat_stream(stream, sessions(spark, sf_dir), messages(spark, sf_dir), chunks, lambda q, _: REFUSAL if len(q) % 2 else f"found: {q}", lambda q, _: f"I cannot say: {q}", path)
    replies = spark.read.schema("frame_id bigint, place int, frame string").parquet(f"{path}/replies/batch=*").where("place = 0")
    saved = spark.read.schema(R.EXCHANGES).parquet(f"{path}/exchanges/batch=*").select((F.col("session_id") * 100 + F.col("seq")).alias("frame_id"), F.lit(True).alias("saved"))
    read = replies.select("frame_id", F.from_json("frame", "type string, token string, message string").alias("f")).select("frame_id", "f.*")
    return read.join(saved, "frame_id", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


@query(f"""WITH {MESSAGES_SQL}, {SESSIONS_SQL}, asked AS (SELECT conv_id * 100 + turn AS frame_id, conv_id, turn, {strip_sql('text')} AS t, conv_id % 3 <> 1 AS owned FROM conversations WHERE role = 'user' AND turn % 4 <> 2),
counted AS (SELECT a.*, (SELECT count(*) FROM asked b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) AS before FROM asked a),
old AS (SELECT session_id, {_GOOD_SQL} AS said, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM messages),
heard AS (SELECT c.*, CASE WHEN owned THEN 2 * before + (SELECT count(*) FROM old WHERE session_id = c.conv_id AND said AND back <= 12 - 2 * before) ELSE 0 END AS n FROM counted c)
SELECT frame_id, CAST(0 AS INTEGER) AS place, 'stream' AS type, n || ' turns: ' || t AS token, NULL AS message, CAST(conv_id % 50 + CAST(NOT owned AS INTEGER) AS VARCHAR) AS user_id FROM heard
UNION ALL SELECT frame_id, 1, CASE WHEN owned THEN 'done' ELSE 'error' END, NULL, CASE WHEN NOT owned THEN 'Unable to save chat history' END, CASE WHEN owned THEN CAST(conv_id % 50 AS VARCHAR) END FROM heard
UNION ALL SELECT conv_id * 100 + turn, 0, 'error', NULL, 'Message cannot be empty', NULL FROM conversations WHERE role = 'user' AND turn % 4 = 2""")
def chat_turns(spark, sf_dir):
    """User turns as frames of one stream in two batches: each answer tells how many turns its generator was shown, and
    every frame that goes out is given, done and error frames too."""
    path = folder(spark, "chat-turns")
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    body = F.to_json(F.struct(F.when(F.col("turn") % 4 == 2, " ").otherwise(F.col("text")).alias("message"), F.col("conv_id").cast("string").alias("session_id")))
    user = F.col("conv_id") % 50 + (F.col("conv_id") % 3 == 1).cast("int")
    sent = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("frame_id"), user.alias("user_id"), F.col("turn").cast("long").alias("seq"), body.alias("frame"), (F.col("turn") > 3).cast("int").alias("part"))
    chunks = S.to_chunks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("b").alias("source"), F.col("text").alias("content")))

    def told(messages):
        query = messages[-1]["content"].rpartition("QUESTION:\n")[2]
        return REFUSAL if messages[0]["content"] == SYSTEM_PROMPT and len(query) % 2 else f"{len(messages) - 2} turns: {query}"

    for part in (0, 1):
        sent.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(sent.drop("part").schema).parquet(f"{path}/in")
        R.chat_stream(stream, sessions(spark, sf_dir), messages(spark, sf_dir), chunks, told, told, path, chat=True, buckets=8)
    replies = spark.read.schema("frame_id bigint, place int, frame string").parquet(f"{path}/replies/batch=*")
    return replies.select("frame_id", "place", F.from_json("frame", "type string, token string, message string, user_id string").alias("f")).select("frame_id", "place", "f.*")


_NUMBERED_SQL = """t AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS k, sum(len(string_split(text, ' ')) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS done_seq FROM conversations WHERE role = 'assistant'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM t)"""


@query(f"WITH {_NUMBERED_SQL} SELECT conv_id AS session_id, text AS message, k AS n_tokens, trim(text) = {_quoted(REFUSAL)} AS refused, CAST(done_seq AS BIGINT) AS done_seq FROM n WHERE conv_id % 7 <> 3 OR nth = 1")
def token_fold_late(spark, sf_dir):
    """All answers of a conversation as one numbered stream: done frames come first, tokens later and some twice; of every
    seventh conversation the first token of the second answer never comes, and nothing after it is told."""
    from pyspark.sql import Window

    path = folder(spark, "token-fold-late")
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.split("text", " ").alias("words"))
    order = Window.partitionBy("conv_id").orderBy("turn")  # the turns of a conversation
    placed = turns.withColumns({"start": F.sum(F.size("words") + 1).over(order) - F.size("words") - 1, "nth": F.row_number().over(order)})
    tokens = placed.select("conv_id", "nth", "start", F.posexplode("words").alias("at", "word")).where("conv_id % 7 <> 3 or nth <> 2 or at > 0")
    stream = tokens.select(F.col("conv_id").alias("session_id"), (F.col("start") + F.col("at")).alias("seq"), F.lit("stream").alias("type"), F.when(F.col("at") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), "word")).alias("token"), "nth")
    done = placed.select(F.col("conv_id").alias("session_id"), (F.col("start") + F.size("words")).alias("seq"), F.lit("done").alias("type"), F.lit(None).cast("string").alias("token"))
    for rows in (done, stream.where("seq % 3 < 2").drop("nth"), stream.where("seq % 3 > 0").drop("nth")):
        rows.select("session_id", F.col("seq").cast("long").alias("seq"), "type", "token").write.mode("append").parquet(f"{path}/in")
        R.run_available(R.fold_tokens(spark.readStream.schema("session_id bigint, seq bigint, type string, token string").parquet(f"{path}/in")), path)
    return spark.read.schema(R.FOLDED).parquet(f"{path}/rows")


@query(_FOLD_SQL)
def token_fold_batch(spark, sf_dir):
    return R.fold_tokens_batch(token_stream(spark, sf_dir)).drop("done_seq")


@query(f"WITH {_ASKED_SQL} SELECT query_id, CASE WHEN {_GREETING_SQL} THEN {_quoted(GREETING)} ELSE 'You said: ' || query END AS answer FROM asked")
def stream_chat(spark, sf_dir):
    """Arriving messages answered batch by batch: greetings at once, the rest by a stand-in generator."""
    path = folder(spark, "stream-chat")
    _asked(spark, sf_dir).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("query_id bigint, query string").parquet(f"{path}/in")

    def answer(df):
        hello = df.where(is_greeting(F.col("query"))).select("query_id", F.lit(GREETING).alias("answer"))
        return hello.unionByName(generate(df.where(~is_greeting(F.col("query"))).withColumn("context", F.lit("")), lambda q, _: f"You said: {q}").select("query_id", "answer"))

    R.answer_stream(stream, answer, path)
    return spark.read.schema("query_id bigint, answer string").parquet(f"{path}/answers/batch=*")

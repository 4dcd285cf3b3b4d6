"""Engine inputs derived from the given tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NEW_CHAT
from ..functions.text import WHITE_RE2
from ..sources.ingest import to_chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("source"), F.col("text").alias("content"))


def chunk_table(spark, sf_dir, size: int = 1800, overlap: int = 120) -> DataFrame:
    return to_chunks(raw_documents(spark, sf_dir), size, overlap)


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def users(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def messages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"))


def sessions(spark, sf_dir) -> DataFrame:
    """One per conversation, and one without messages for each that ends on a user turn."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last"))
    ids = c.select(F.explode(F.when(F.col("last") == "user", F.array(F.col("conv_id"), F.col("conv_id") + 1000000000)).otherwise(F.array("conv_id"))).alias("id"))
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60)
    return ids.select("id", (F.col("id") % 50).alias("user_id"), F.lit(NEW_CHAT).alias("title"), start.alias("created_at"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60 + F.col("id") * 7919 % 86400).alias("updated_at"))


def token_stream(spark, sf_dir) -> DataFrame:
    """Assistant turns cut at spaces, one frame per token, then a done frame."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("session_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "word"))
    words = c.select("session_id", F.col("pos").cast("long").alias("seq"), F.lit("stream").alias("type"), F.when(F.col("pos") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), "word")).alias("token"))
    return words.unionByName(words.groupBy("session_id").agg((F.max("seq") + 1).alias("seq")).select("session_id", "seq", F.lit("done").alias("type"), F.lit(None).cast("string").alias("token")))


RAW_SQL = "raw AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN source || '/' || doc_id || '.txt' END AS source, text AS content FROM documents)"


def uuid_sql(text: str) -> str:
    h = f"md5({text})"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12))"


def chunks_sql(size: int = 1800, overlap: int = 120, raw: str = "raw", out: str = "chunks") -> str:
    step = max(size - overlap, 1)
    new_id = uuid_sql("coalesce(source,'')||'|'||doc_id||'|'||chunk_index||'|'||content")
    return f"""
{out}_clean AS (SELECT doc_id, source, trim(regexp_replace(coalesce(content,''), '{WHITE_RE2}', ' ', 'g')) AS c FROM {raw}),
{out}_sized AS (SELECT *, CASE WHEN length(c) <= {size} THEN 1 ELSE CAST(ceil((length(c) - {size}) / {step}.0) AS BIGINT) + 1 END AS k FROM {out}_clean WHERE c <> ''),
{out}_windows AS (SELECT doc_id, source, i, trim(substring(c, CAST(i * {step} + 1 AS BIGINT), {size})) AS content FROM {out}_sized, LATERAL unnest(range(k)) AS t(i)),
{out}_numbered AS (SELECT doc_id, source, content, CAST(row_number() OVER (PARTITION BY doc_id, source ORDER BY i) - 1 AS INTEGER) AS chunk_index FROM {out}_windows WHERE content <> ''),
{out} AS (SELECT {new_id} AS id, source, chunk_index, content, doc_id FROM {out}_numbered)"""


def postings_sql(name: str, key: str, text: str, source: str, dimension: int = 1024) -> str:
    return f"""
{name}_tokens AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '[a-z0-9]+') AS t FROM {source}),
{name}_features AS (SELECT k, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS f FROM {name}_tokens),
{name}_hashed AS (SELECT k, CAST(('0x' || substr(md5(f), 1, 16)) AS UBIGINT) AS h FROM {name}_features),
{name} AS (SELECT k AS {key}, CAST(h % {dimension} AS INTEGER) AS bucket, CAST(sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM {name}_hashed GROUP BY ALL HAVING sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) <> 0)"""


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WHITE_RE2}|{WHITE_RE2}$', '', 'g')"


MESSAGES_SQL = "messages AS (SELECT conv_id * 100 + turn AS id, conv_id AS session_id, role, text AS content FROM conversations)"
SESSIONS_SQL = """
session_ids AS (SELECT unnest(CASE WHEN arg_max(role, turn) = 'user' THEN [conv_id, conv_id + 1000000000] ELSE [conv_id] END) AS id FROM conversations GROUP BY conv_id),
sessions AS (SELECT id, id % 50 AS user_id, 'New chat' AS title, 1704067200 + id * 60 AS created_s, 1704067200 + id * 60 + id * 7919 % 86400 AS updated_s FROM session_ids)"""
USERS_SQL = "users AS (SELECT c_custkey AS id, c_name AS username FROM customer)"

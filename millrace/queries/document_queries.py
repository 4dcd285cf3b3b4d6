"""Queries on texts, files, chunks and documents."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.text import WHITE_RE2, basename, features, normalise_space, tokens, upper_by_character
from ..functions.vectors import hashed_dense, norm, normalised, postings, rounded, squared_norms, with_vectors
from ..operators import documents as D
from ..operators.neighbours import index_vectors, nearest
from ..operators.plugins import embed
from ..operators.retrieval import knn
from ..operators.running import numbered
from ..operators.store import DocumentStore
from ..plans import pipelines as P
from ..scratch import folder
from ..sources import ingest as S
from ..streaming import file_stream as I
from .fixtures import RAW_SQL, chunk_table, chunks_sql, postings_sql, raw_documents, strip_sql, table, uuid_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, trim(regexp_replace(text, '{WHITE_RE2}', ' ', 'g')) AS clean, length(text) AS n_before FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalise_space(F.col("text")).alias("clean"), F.length("text").cast("long").alias("n_before"))


@query("SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def tokenize_counts(spark, sf_dir):
    t = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"WITH {RAW_SQL}, {chunks_sql()} SELECT id, source, chunk_index, content FROM chunks")
def chunk_documents(spark, sf_dir):
    return chunk_table(spark, sf_dir).drop("doc_id")


@query(f"WITH {RAW_SQL}, {chunks_sql(200, 50)} SELECT id, source, chunk_index, content FROM chunks")
def chunk_small_overlap(spark, sf_dir):
    return chunk_table(spark, sf_dir, 200, 50).drop("doc_id")


@query(f"WITH {RAW_SQL}, {chunks_sql()} SELECT count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks FROM chunks")
def ingest_report(spark, sf_dir):
    return S.ingest_report(chunk_table(spark, sf_dir))


def _files(spark, sf_dir):
    tail = F.element_at(F.array(F.lit(".TXT"), F.lit(".pdf"), F.lit(".Docx"), F.lit(".exe"), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("arrival"), F.concat(F.regexp_replace("url", r"\?.*$", ""), tail).alias("path"))


_FILES_SQL = r"files AS (SELECT page_id AS arrival, regexp_replace(url, '\?.*$', '') || (['.TXT', '.pdf', '.Docx', '.exe', ''])[page_id % 5 + 1] AS path FROM pages)"


@query(f"WITH {_FILES_SQL}, n AS (SELECT *, lower(regexp_extract(path, '[^/]*$', 0)) AS name FROM files) SELECT arrival, path, name, regexp_extract(name, '\\.([^./]*)$', 1) AS ext, name <> '' AND regexp_extract(name, '\\.([^./]*)$', 1) IN ('pdf', 'docx', 'txt') AS admitted FROM n")
def admit_files(spark, sf_dir):
    return S.admit(_files(spark, sf_dir))


_NAMES_SQL = """names AS (SELECT page_id AS arrival, 'doc' || page_id % 13 || (['', '', '_copy', '', '_copy2', '', '_copy_copy'])[page_id % 7 + 1] || (['.txt', '.txt', '.pdf'])[page_id % 3 + 1] AS name FROM pages),
old AS (SELECT DISTINCT 'doc' || page_id % 13 || '_copy' || page_id % 4 + 2 || '.txt' AS name FROM pages WHERE page_id % 50 = 0)"""


@query(f"""WITH RECURSIVE {_NAMES_SQL}, n AS (SELECT row_number() OVER (ORDER BY arrival) AS i, *, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS stem, regexp_extract(name, '[^.]*$') AS ext FROM names),
stored(i, arrival, name, stored_name, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), (SELECT list(name) FROM old)
UNION ALL SELECT t.i, t.arrival, t.name, t.pick, list_append(t.used, t.pick) FROM (
SELECT n.i, n.arrival, n.name, s.used, list_filter(list_transform(range(0, s.i + 60), lambda k: CASE k WHEN 0 THEN n.name WHEN 1 THEN n.stem || '_copy.' || n.ext ELSE n.stem || '_copy' || k || '.' || n.ext END), lambda c: NOT list_contains(s.used, c))[1] AS pick FROM stored s JOIN n ON n.i = s.i + 1) t)
SELECT arrival, name, stored_name FROM stored WHERE i > 0""")
def rename_collisions(spark, sf_dir):
    """Files named so that derived names meet names that arrive as they are, and names that are stored already."""
    pages = table(spark, sf_dir, "pages")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    stem = F.concat(F.lit("doc"), (F.col("page_id") % 13).cast("string"))
    names = pages.select(F.col("page_id").alias("arrival"), F.concat(stem, pick(7, "", "", "_copy", "", "_copy2", "", "_copy_copy"), pick(3, ".txt", ".txt", ".pdf")).alias("name"))
    old = pages.where("page_id % 50 = 0").select(F.concat(stem, F.lit("_copy"), (F.col("page_id") % 4 + 2).cast("string"), F.lit(".txt")).alias("name"))
    return S.rename_collisions(names, old)


@query("WITH p AS (SELECT source || '/' || doc_id || '.txt' AS file, string_split(text, chr(10)) AS l FROM documents) SELECT file, array_to_string(list_transform(l, lambda x: CASE WHEN length(x) < 3 THEN '' ELSE x END), chr(10)) AS content FROM p")
def assemble_parts(spark, sf_dir):
    file = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    parts = table(spark, sf_dir, "documents").select(file.alias("file"), F.posexplode(F.split("text", "\n")).alias("part_no", "text"))
    return S.assemble_parts(parts.withColumn("text", F.when(F.length("text") >= 3, F.col("text"))))  # shorter lines: null pages


_ROLLUP_SQL = f"""WITH {RAW_SQL}, {chunks_sql()}, keyed AS (SELECT *, coalesce(nullif(source, ''), id) AS doc_key FROM chunks)"""


@query(f"{_ROLLUP_SQL} SELECT doc_key, max(source) AS source, string_agg(content, chr(10) || chr(10) ORDER BY coalesce(chunk_index, 0), id) AS content, count(*) AS chunk_count FROM keyed GROUP BY doc_key")
def document_rollup(spark, sf_dir):
    return D.rollup(chunk_table(spark, sf_dir))


@query(f"{_ROLLUP_SQL} SELECT count(DISTINCT doc_key) AS documents, count(*) AS chunks, count(DISTINCT nullif(source, '')) AS sources FROM keyed")
def dashboard_stats(spark, sf_dir):
    return D.dashboard(chunk_table(spark, sf_dir))


@query(f"{_ROLLUP_SQL} SELECT doc_key, coalesce(max(source), 'Manual entry') AS label, count(*) AS chunk_count, count(*) || CASE count(*) WHEN 1 THEN ' chunk' ELSE ' chunks' END AS caption FROM keyed GROUP BY doc_key")
def source_listing(spark, sf_dir):
    return D.listing(chunk_table(spark, sf_dir))


@query(f"""{_ROLLUP_SQL}, keys AS (SELECT id AS key FROM chunks WHERE chunk_index = 1 OR source IS NULL UNION SELECT source FROM chunks WHERE chunk_index = 2 UNION SELECT 'missing-' || lang FROM documents),
hit AS (SELECT k.key, c.source, c.id FROM keys k JOIN chunks c ON k.key = c.id)
SELECT h.key, c.id, c.source, c.chunk_index FROM hit h JOIN chunks c ON c.source = h.source
UNION ALL SELECT h.key, c.id, c.source, c.chunk_index FROM hit h JOIN chunks c ON c.id = h.id WHERE h.source IS NULL
UNION ALL SELECT k.key, c.id, c.source, c.chunk_index FROM keys k JOIN chunks c ON c.source = k.key
UNION ALL SELECT k.key, NULL, NULL, NULL FROM keys k WHERE k.key LIKE 'missing-%'""")
def resolve_document_keys(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    keys = c.where("chunk_index = 1 or source is null").select(F.col("id").alias("key")).union(c.where("chunk_index = 2").select("source")).union(table(spark, sf_dir, "documents").select(F.concat(F.lit("missing-"), "lang")))
    found, missing = D.resolve(keys, c)
    return found.unionByName(missing, allowMissingColumns=True)


@query(f"{_ROLLUP_SQL} SELECT id, source, chunk_index, row_number() OVER (PARTITION BY source ORDER BY chunk_index NULLS LAST, id) AS position FROM chunks")
def document_chunks_sorted(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.col("chunk_index").asc_nulls_last(), "id")
    return chunk_table(spark, sf_dir).select("id", "source", "chunk_index", F.row_number().over(order).cast("long").alias("position"))


@query(f"WITH {RAW_SQL}, {chunks_sql()} SELECT id, source, chunk_index, row_number() OVER (ORDER BY source NULLS LAST, chunk_index NULLS LAST, id) - 1 AS position FROM chunks")
def chunks_in_order(spark, sf_dir):
    """Where each chunk stands in the listing of all documents: by source, then index, those without one last."""
    c = chunk_table(spark, sf_dir).select("id", "source", "chunk_index", F.col("source").isNull().alias("no_source"), F.col("chunk_index").isNull().alias("no_index"))
    return numbered(c, [], ["no_source", "source", "no_index", "chunk_index", "id"], "position").drop("no_source", "no_index")


_UPDATES_SQL = "updates AS (SELECT r.doc_id, r.source, upper(r.content) AS content FROM raw r JOIN documents d USING (doc_id) WHERE d.lang = 'es' AND r.source IS NOT NULL)"


@query(f"WITH {RAW_SQL}, {chunks_sql()}, {_UPDATES_SQL}, {chunks_sql(raw='updates', out='fresh')} SELECT id, source, chunk_index, content, doc_id FROM chunks WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM updates) OR source IS NULL UNION ALL SELECT id, source, chunk_index, content, doc_id FROM fresh")
def replace_documents(spark, sf_dir):
    spanish = table(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id")
    updates = raw_documents(spark, sf_dir).where("source is not null").join(spanish, "doc_id", "left_semi").select("doc_id", "source", upper_by_character(F.col("content")).alias("content"))
    return D.replace(chunk_table(spark, sf_dir), updates).select("id", "source", "chunk_index", "content", "doc_id")


@query(f"WITH {RAW_SQL}, {chunks_sql()}, gone AS (SELECT r.source FROM raw r JOIN documents d USING (doc_id) WHERE d.lang = 'de') SELECT source, count(*) AS n, source IN (SELECT source FROM gone WHERE source IS NOT NULL) AS deleted FROM chunks WHERE source IS NOT NULL GROUP BY source")
def delete_documents(spark, sf_dir):
    german = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    left, gone = D.delete(chunk_table(spark, sf_dir).where("source is not null"), raw_documents(spark, sf_dir).join(german, "doc_id", "left_semi"))
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("deleted", F.lit(False)).unionByName(gone.select("source", F.col("deleted").alias("n"), F.lit(True).alias("deleted")))


@query(f"WITH {RAW_SQL}, {chunks_sql()}, joined AS (SELECT CAST(0 AS BIGINT) AS doc_id, source, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) AS content FROM chunks WHERE source IS NOT NULL GROUP BY source), {chunks_sql(raw='joined', out='again')} SELECT id, source, chunk_index, content FROM again")
def update_rechunk(spark, sf_dir):
    return D.rechunk(chunk_table(spark, sf_dir), size=1800, overlap=120).drop("doc_id")


@query(f"WITH {RAW_SQL}, {chunks_sql()}, {postings_sql('p', 'id', 'content', 'chunks')} SELECT bucket, count(*) AS n_chunks, CAST(sum(weight) AS BIGINT) AS sum_weight, CAST(sum(weight * weight) AS BIGINT) AS sum_square FROM p GROUP BY bucket")
def term_buckets_md5(spark, sf_dir):
    w = F.col("weight")
    return postings(chunk_table(spark, sf_dir), "id", "content").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(w).alias("sum_weight"), F.sum(w * w).alias("sum_square"))


@query(f"WITH {RAW_SQL}, {chunks_sql()}, {postings_sql('p', 'id', 'content', 'chunks')} SELECT id, CAST(sum(weight * weight) AS BIGINT) AS norm2 FROM p GROUP BY id")
def vector_norms(spark, sf_dir):
    return squared_norms(postings(chunk_table(spark, sf_dir), "id", "content"), "id")


_KNN_SQL = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, e.vec_id, round({distance}, 9) AS distance FROM q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings) e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _knn(spark, sf_dir, k, metric):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn(e.where("vec_id % 100 = 0"), e, k, metric).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(_KNN_SQL.format(distance="1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))", k=5))
def knn_cosine_top5(spark, sf_dir):
    return _knn(spark, sf_dir, 5, "cosine")


@query(_KNN_SQL.format(distance="list_distance(a, b)", k=4))
def knn_l2_top4(spark, sf_dir):
    return _knn(spark, sf_dir, 4, "l2")


def _indexed(spark, sf_dir, k, metric):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, _ = nearest(e.where("vec_id % 100 = 0"), index_vectors(e, 64, metric, block_rows=64), k)
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(_KNN_SQL.format(distance="1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))", k=5))
def knn_indexed_cosine(spark, sf_dir):
    """The same through an index of balls that rules blocks out."""
    return _indexed(spark, sf_dir, 5, "cosine")


@query(_KNN_SQL.format(distance="list_distance(a, b)", k=4))
def knn_indexed_l2(spark, sf_dir):
    return _indexed(spark, sf_dir, 4, "l2")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(a, a)), 6) AS norm, list_transform(a, lambda x: round(x / sqrt(list_inner_product(a, a)), 6)) AS unit FROM v")
def normalize_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.transform(normalised(F.col("embedding")), lambda x: rounded(x, 6)).alias("unit"))


@query("SELECT vec_id, len(e) AS found FROM (SELECT vec_id, CASE WHEN label = 0 THEN embedding[1:63] ELSE embedding END AS e FROM embeddings) WHERE len(e) <> 64")
def vector_dimension_violations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("label") == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return D.dimension_violations(e, 64)


@query("WITH u AS (SELECT CASE c_nationkey WHEN 0 THEN ' ' || upper(c_mktsegment) WHEN 1 THEN substr(c_name, 1, 2) ELSE c_name END AS username FROM customer) SELECT 'username length' AS rule, username AS key FROM u WHERE length(username) NOT BETWEEN 3 AND 80 UNION ALL SELECT 'username unique', lower(trim(username)) FROM u GROUP BY 2 HAVING count(*) > 1")
def constraint_violations(spark, sf_dir):
    name = F.when(F.col("c_nationkey") == 0, F.concat(F.lit(" "), F.upper("c_mktsegment"))).when(F.col("c_nationkey") == 1, F.substring("c_name", 1, 2)).otherwise(F.col("c_name"))
    return D.name_violations(table(spark, sf_dir, "customer").select(name.alias("username")))


@query()
def embed_blake2b(spark, sf_dir):
    return hashed_dense(chunk_table(spark, sf_dir), "id", "content")


@query()
def embed_plugin(spark, sf_dir):
    """Chunks through a pluggable embedder (letter shares) in batches, dimension checked."""
    return embed(chunk_table(spark, sf_dir), "content", lambda texts: [[t.count(c) / max(len(t), 1) for c in "etaoinsr"] for t in texts], dimension=8).select("id", "embedding", "embed_error")


@query(r"SELECT page_id, lower(regexp_extract(regexp_replace(url, '\?.*$', ''), '[^/]*$', 0)) AS name, printf('%.2f MB', greatest(length(html) / 1048576.0, 0.01)) AS size_label FROM pages")
def file_labels(spark, sf_dir):
    from ..functions.text import megabytes

    return table(spark, sf_dir, "pages").select("page_id", basename(F.regexp_replace("url", r"\?.*$", "")).alias("name"), megabytes(F.length("html")).alias("size_label"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) SELECT doc_id, len(t) + greatest(len(t) - 1, 0) AS n_features, CASE WHEN len(t) > 1 THEN t[1] || ' ' || t[2] END AS first_pair FROM t")
def feature_bigrams(spark, sf_dir):
    f, t = features(F.col("text")), tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(f).cast("long").alias("n_features"), F.when(F.size(t) > 1, F.get(f, F.size(t))).alias("first_pair"))


@query(f"WITH {RAW_SQL} SELECT {uuid_sql("doc_id || '|' || coalesce(content, '')")} AS id, md5(coalesce(content, '')) AS content_md5, CASE WHEN source IS NULL THEN 0 ELSE 1 END AS n_metadata, source FROM raw")
def build_store(spark, sf_dir):
    """Rows of the generic store: an id for each row, the metadata given or none."""
    raw = raw_documents(spark, sf_dir).withColumns({"content": F.coalesce("content", F.lit("")), "metadata": F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source")))})
    return S.build_index(raw, "doc_id", "content", "metadata").select("id", F.md5("content").alias("content_md5"), F.size("metadata").alias("n_metadata"), F.col("metadata")["source"].alias("source"))


def _vector_marks(df):
    """What a vector holds, in whole numbers: buckets in use, and the places of positive and of negative ones summed up."""
    places = lambda keep: F.aggregate(F.transform("embedding", lambda x, i: F.when(keep(x), i).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumns({"n_buckets": F.size(F.filter("embedding", lambda x: x != 0)).cast("long"), "positive": places(lambda x: x > 0), "negative": places(lambda x: x < 0)}).drop("embedding")


def _marks_sql(chunks: str, out: str) -> str:
    return f"""{postings_sql(out + '_p', 'id', 'content', chunks)}, {out} AS (SELECT c.id, c.source, c.chunk_index, c.content, count(p.bucket) AS n_buckets, CAST(coalesce(sum(CASE WHEN p.weight > 0 THEN p.bucket END), 0) AS BIGINT) AS positive, CAST(coalesce(sum(CASE WHEN p.weight < 0 THEN p.bucket END), 0) AS BIGINT) AS negative
FROM {chunks} c LEFT JOIN {out}_p p USING (id) GROUP BY ALL)"""


_MARKED = ["id", "source", "chunk_index", "content", "embedding"]


@query(f"WITH {RAW_SQL}, {chunks_sql()}, {_marks_sql('chunks', 'm')} SELECT * FROM m")
def ingest_vectors(spark, sf_dir):
    """Documents cut, embedded and stored; what the table holds."""
    path = folder(spark, "ingest-vectors")
    S.append(P.chunks_with_vectors(raw_documents(spark, sf_dir), _md5_vectors), path)
    return _vector_marks(spark.read.parquet(path).select(_MARKED))


@query(f"WITH {RAW_SQL}, {chunks_sql()}, {_UPDATES_SQL}, {chunks_sql(raw='updates', out='fresh')}, everything AS (SELECT * FROM chunks WHERE source IS NULL OR source NOT IN (SELECT source FROM updates) UNION ALL SELECT * FROM fresh), {_marks_sql('everything', 'm')} SELECT * FROM m")
def rebuild_vectors(spark, sf_dir):
    """Documents replaced in the stored table: new chunks come with their vectors."""
    path = folder(spark, "rebuild-vectors")
    S.append(P.chunks_with_vectors(raw_documents(spark, sf_dir), _md5_vectors), path)
    spanish = table(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id")
    updates = raw_documents(spark, sf_dir).where("source is not null").join(spanish, "doc_id", "left_semi").select("doc_id", "source", upper_by_character(F.col("content")).alias("content"))
    return _vector_marks(P.rebuild(spark.read.parquet(path), updates, _md5_vectors).select(_MARKED))


def _md5_vectors(df):
    return with_vectors(df, digest="md5")


_CREATED_SQL = f"created AS (SELECT doc_id, coalesce(source, 'manual-' || {uuid_sql("doc_id || '|' || content")}) AS source, content FROM (SELECT doc_id, source, {strip_sql('content')} AS content FROM raw) WHERE content <> '')"


@query(f"WITH {RAW_SQL}, {_CREATED_SQL}, {chunks_sql(raw='created', out='c')} SELECT id, source, chunk_index, content FROM c")
def create_documents(spark, sf_dir):
    """New documents; those without a source get one of their own."""
    return P.create_documents(raw_documents(spark, sf_dir), _md5_vectors).select("id", "source", "chunk_index", "content")


@query(f"WITH {RAW_SQL}, {chunks_sql()} SELECT 'content length' AS rule, CAST(doc_id AS VARCHAR) AS key FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS content FROM documents) WHERE coalesce(length(content), 0) < 1 UNION ALL SELECT CASE chunk_index WHEN 1 THEN 'vector missing' ELSE 'vector length' END, id FROM chunks WHERE chunk_index IN (1, 2)")
def stored_violations(spark, sf_dir):
    """Documents without content; chunks whose vector is missing or too short."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 != 0, F.col("text")).alias("content"))
    c = _md5_vectors(chunk_table(spark, sf_dir)).withColumn("embedding", F.when(F.col("chunk_index") == 2, F.slice("embedding", 1, 9)).when(F.col("chunk_index") != 1, F.col("embedding")))
    return D.content_violations(d).unionByName(D.vector_violations(c, 1024))


@query("SELECT page_id, page_id % 5 IN (0, 1) AS accepted, CASE page_id % 5 WHEN 0 THEN replace(html, '<p>', '<P>') WHEN 1 THEN html END AS content FROM pages")
def route_files(spark, sf_dir):
    """Files of five endings through the extractors of two; all others are rejected."""
    ending = F.element_at(F.array(F.lit(".txt"), F.lit(".pdf"), F.lit(".docx"), F.lit(".exe"), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), F.col("page_id").cast("string"), ending).alias("path"), F.col("html").alias("content"))

    def marked(batches):
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("content"), "content", pc.replace_substring(batch.column("content"), "<p>", "<P>"))

    good, bad = S.route_by_type(files, {"txt": marked, "pdf": lambda batches: batches})
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.select("path", F.lit(None).cast("string").alias("content"), F.lit(False).alias("accepted")))
    return both.select(F.regexp_extract("path", r"in/(\d+)", 1).cast("long").alias("page_id"), "accepted", "content")


# A bucketed store changed by key ---------------------------------------------------------------------------------------


def _changed_store(spark, sf_dir):
    """Documents appended, then changed by source or by the id of a chunk, then some deleted; both reports."""
    raw, chunked = raw_documents(spark, sf_dir), chunk_table(spark, sf_dir)
    store = DocumentStore(spark, folder(spark, "store"), buckets=16)
    store.append(0, raw)
    ids = chunked.where(F.when(F.col("source").isNull(), 0).otherwise(1) == F.col("chunk_index")).select("doc_id", "id")  # of a document with a source, its second chunk
    keyed = raw.join(ids, "doc_id", "left").withColumn("by_id", F.col("source").isNull() | (F.col("doc_id") % 3 == 0) & F.col("id").isNotNull()).withColumn("key", F.when(F.col("by_id"), F.upper("id")).otherwise(F.col("source")))
    kind = F.col("doc_id") % 7
    content = F.when(kind == 2, " \n ").when(kind.isin(3, 5), F.translate("content", "eo", "EO"))
    key = F.when(kind == 5, F.concat(F.lit("missing-"), F.col("doc_id").cast("string"))).otherwise(F.col("key"))
    changes = keyed.where(kind.between(1, 5)).select(key.alias("key"), content.alias("content"), F.when(kind == 4, F.concat(F.lit("moved-"), F.col("doc_id").cast("string"))).alias("source")).where("key is not null")
    updated = store.update(1, changes)
    gone = keyed.where(kind == 6).select("key").where("key is not null").unionByName(spark.createDataFrame([("nothing",)], "key string"))
    return store, updated.unionByName(store.delete(2, gone))


_STORE_SQL = f"""WITH {RAW_SQL}, {chunks_sql()},
ids AS (SELECT doc_id, id FROM chunks WHERE chunk_index = CASE WHEN source IS NULL THEN 0 ELSE 1 END),
keyed AS (SELECT r.*, r.doc_id % 7 AS kind, CASE WHEN r.source IS NULL OR r.doc_id % 3 = 0 AND i.id IS NOT NULL THEN upper(i.id) ELSE r.source END AS key, coalesce(r.source, i.id) AS doc_key FROM raw r LEFT JOIN ids i USING (doc_id)),
known AS (SELECT * FROM keyed WHERE doc_key IS NOT NULL AND key IS NOT NULL),
mine AS (SELECT k.doc_id, k.kind, k.key, k.doc_key, k.source, c.id, c.chunk_index, c.content FROM known k JOIN chunks c ON c.doc_id = k.doc_id AND (k.source IS NOT NULL OR c.chunk_index = 0)),
again AS (SELECT doc_key AS doc_id, CASE WHEN kind = 4 THEN 'moved-' || doc_id ELSE any_value(source) END AS source, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) AS content FROM mine WHERE kind IN (1, 4) GROUP BY kind, mine.doc_id, doc_key),
given AS (SELECT * FROM again UNION ALL SELECT doc_key, source, {strip_sql("translate(content, 'eo', 'EO')")} FROM known WHERE kind = 3),
{chunks_sql(raw='given', out='fresh')},
left_over AS (SELECT id, source, chunk_index, content FROM chunks WHERE id NOT IN (SELECT id FROM mine WHERE kind IN (1, 3, 4, 6)) UNION ALL SELECT id, source, chunk_index, content FROM fresh)"""


@query(f"{_STORE_SQL} SELECT * FROM left_over")
def store_changes(spark, sf_dir):
    """What a store holds after updates with, without and with blank content, by source and by id, and deletions."""
    return _changed_store(spark, sf_dir)[0].chunks()


@query(f"""{_STORE_SQL}, n AS (SELECT doc_id AS doc_key, count(*) AS n FROM fresh GROUP BY 1), old AS (SELECT doc_key, count(*) AS n FROM mine GROUP BY 1)
SELECT key, CASE kind WHEN 2 THEN 'blank' WHEN 6 THEN 'deleted' ELSE 'updated' END AS status, CASE kind WHEN 2 THEN 0 WHEN 6 THEN old.n ELSE n.n END AS chunks FROM known LEFT JOIN n USING (doc_key) LEFT JOIN old USING (doc_key) WHERE kind IN (1, 2, 3, 4, 6)
UNION ALL SELECT 'missing-' || doc_id, 'missing', 0 FROM raw WHERE doc_id % 7 = 5 UNION ALL SELECT 'nothing', 'missing', 0""")
def store_reports(spark, sf_dir):
    return _changed_store(spark, sf_dir)[1]


@query(f"{_STORE_SQL}, k AS (SELECT coalesce(source, id) AS doc_key, source FROM left_over), whole AS (SELECT count(DISTINCT doc_key) AS documents, count(*) AS chunks, count(DISTINCT source) AS sources FROM k) SELECT doc_key, coalesce(any_value(source), 'Manual entry') AS label, count(*) AS chunk_count, documents, chunks, sources FROM k, whole GROUP BY ALL")
def store_listing(spark, sf_dir):
    """The listing from counts that changes keep, beside the dashboard's totals; no contents are read."""
    store = _changed_store(spark, sf_dir)[0]
    return store.listing().drop("caption").crossJoin(F.broadcast(store.dashboard()))  # one row


_ARRIVED_SQL = r"""files AS (SELECT page_id, 'doc' || page_id % 13 || (['', '_copy', '', '_copy2', ''])[page_id % 5 + 1] || (['.txt', '.PDF', '.txt', '.exe', '.docx', ''])[page_id % 6 + 1] AS name, html FROM pages),
n AS (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id, lower(name) AS name, regexp_extract(lower(name), '^(.*)\.[^.]*$', 1) AS stem, regexp_extract(lower(name), '[^.]*$') AS ext, html FROM files WHERE page_id % 6 IN (0, 1, 2, 4)),
stored(i, page_id, stored_name, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[])
UNION ALL SELECT t.i, t.page_id, t.pick, list_append(t.used, t.pick) FROM (
SELECT n.i, n.page_id, s.used, list_filter(list_transform(range(0, s.i + 2), lambda k: CASE k WHEN 0 THEN n.name WHEN 1 THEN n.stem || '_copy.' || n.ext ELSE n.stem || '_copy' || k || '.' || n.ext END), lambda c: NOT list_contains(s.used, c))[1] AS pick FROM stored s JOIN n ON n.i = s.i + 1) t),
raw AS (SELECT page_id AS doc_id, stored_name AS source, html AS content FROM stored JOIN pages USING (page_id) WHERE page_id % 6 <> 4)"""


@query(f"WITH RECURSIVE {_ARRIVED_SQL}, {chunks_sql()} SELECT source, chunk_index, content FROM chunks")
def ingest_arrivals(spark, sf_dir):
    """Pages as files of six endings that arrive in three batches, their names meeting; the second batch comes twice."""
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    name = F.concat(F.lit("doc"), (F.col("page_id") % 13).cast("string"), pick("", "_copy", "", "_copy2", ""), pick(".txt", ".PDF", ".txt", ".exe", ".docx", ""))
    path = F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit("/"), name)
    pages = table(spark, sf_dir, "pages")
    files = pages.select("page_id", path.alias("path"), F.timestamp_seconds(1700000000 + F.col("page_id")).alias("modificationTime"), F.col("html").cast("binary").alias("content"))
    home, n = folder(spark, "arrivals"), pages.count()
    store, names = DocumentStore(spark, f"{home}/store", 16), I.StoredNames(spark, f"{home}/names", 16)
    for batch in (0, 1, 1, 2):
        part = files.where((F.floor(F.col("page_id") * 3 / n)).cast("int") == batch)
        I.ingest_batch(batch, part.drop("page_id"), {"txt": S.utf8_text, "pdf": S.utf8_text}, names, store, f"{home}/rejected")
    return store.chunks().select("source", "chunk_index", "content")

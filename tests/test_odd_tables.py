"""Queries against their SQL on small tables of values that the given ones rarely hold."""

import duckdb
import pytest
from conftest import plain

from millrace import registry
from millrace.functions.text import upper_by_character

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def same(spark, tmp_path):
    """Compare a query with its SQL over tables (name, rows, schema), to the sign of a zero."""

    def told(value):
        return "[" + ",".join(map(told, value)) + "]" if isinstance(value, (list, tuple)) else repr(value) if isinstance(value, float) else plain(value)

    def check(query, **tables):
        con = duckdb.connect()
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        df = QUERIES[query](spark, str(tmp_path))
        found = con.execute(SQL[query])
        at = [[d[0] for d in found.description].index(c) for c in df.columns]
        assert sorted(told(list(r)) for r in df.collect()) == sorted(told([r[i] for i in at]) for r in found.fetchall())

    return check


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SHARP = [(1, "la calle Größe, straße ŉ ﬁn ᾳ", "es", "a", 29), (2, "ß " * 1500, "es", "b", 3000), (3, "große", "de", "c", 5), (10, "ß", "es", "d", 1)]


def test_upper_case_of_every_character(spark):
    given = [chr(i) for i in range(1, 0x1F000) if not 0xD800 <= i < 0xE000]
    text = spark.createDataFrame([("".join(given),)], "c string")
    want = duckdb.connect().execute("SELECT upper(?)", ["".join(given)]).fetchone()[0]
    assert text.select(upper_by_character(text["c"]).alias("c")).first().c == want


def test_documents_replaced_by_capitals_with_a_sharp_s(same):
    same("replace_documents", documents=(SHARP, DOCUMENTS))


def test_vectors_rebuilt_of_capitals_with_a_sharp_s(same):
    same("rebuild_vectors", documents=(SHARP, DOCUMENTS))


def test_small_negative_numbers_round_to_a_negative_zero(same):
    rows = [(1, [1.0, -1e-8, 1e-8, 0.0]), (2, [-0.0, -3.0, 4.0, -4e-6]), (3, [-0.5, 0.5, -2e-6, 0.70710677])]
    same("normalize_vectors", embeddings=(rows, "vec_id long, embedding array<float>"))

import os
import sys
import tempfile

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, os.environ.get("PYTHONPATH", "")]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", work).config("spark.checkpoint.dir", f"{work}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(float(f"{value:.9g}") + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if hasattr(value, "asDict"):
        return plain(list(value))
    return repr(value)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf):
    """Compare a query's rows with its SQL's, columns by name, order aside."""

    def check(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        relation = duck.sql(sql)
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        assert ours == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())

    return check

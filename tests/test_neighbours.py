"""The index of balls against the plain search: ties, zero vectors, hot cells, odd rows."""

import numpy as np
import pytest

from millrace.operators.neighbours import index_vectors, nearest
from millrace.operators.retrieval import knn


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, "nan" if r.distance != r.distance else round(r.distance, 7)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_equals_the_plain_search(spark, metric):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 4
    vectors = [(int(i), [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=6) * 0.2)]) for i in range(1500)]
    vectors += [(2000 + i, vectors[0][1]) for i in range(300)] + [(3000 + i, [0.0] * 6) for i in range(5)] + [(4000, [1.0]), (4001, None)]
    base = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = base.where("vec_id % 50 = 0 or vec_id = 3001 or vec_id = 4001").where("vec_id <> 4000")
    index = index_vectors(base, 6, metric, block_rows=40, most_pivots=16)
    found, pairs = nearest(asked, index, 7)
    assert rows(found) == rows(knn(asked.where("vec_id <> 4001"), base, 7, metric))
    blocks = index.blocks.count()
    directed = pairs.where("query_id < 3000")
    assert directed.count() < 0.5 * blocks * directed.select("query_id").distinct().count()
    assert index.blocks.agg({"n": "max"}).first()[0] <= 40


def test_more_neighbours_than_there_are(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found, _ = nearest(base, index_vectors(base, 2, block_rows=1), 9)
    assert rows(found) == rows(knn(base, base, 9))
    assert nearest(base.limit(0), index_vectors(base, 2), 3)[0].count() == 0 and nearest(base, index_vectors(base.limit(0), 2), 3)[0].count() == 0
    zeros = base.where("vec_id = 2")
    assert rows(nearest(base, index_vectors(zeros, 2), 3)[0]) == rows(knn(base, zeros, 3))

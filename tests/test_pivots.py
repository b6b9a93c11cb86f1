"""Search round pivots against the scan, and the share of vectors it reads."""

import numpy as np
import pytest

from corpusgraph.operators import pivots, ranking

KIND = "node_id long, embedding array<float>"


def clustered(n, seed=1, width=0.05, dimension=24):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(20, dimension))
    return [(i, (centre[i % 20] + width * r.normal(size=dimension)).tolist()) for i in range(n)]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["node_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_equals_the_scan(spark, monkeypatch, parts):
    monkeypatch.setattr(pivots, "PACK", 50)
    monkeypatch.setattr(pivots, "QUERIES", 7)
    v = clustered(1500) + [(2000, [0.0] * 24), (2001, None), (2002, [0.0] * 24), *((3000 + i, clustered(1)[0][1]) for i in range(130))]
    vectors = spark.createDataFrame(v, KIND).repartition(parts)
    q = spark.createDataFrame([*clustered(30, 2), (50, [0.0] * 24), (51, None), (52, v[0][1])], KIND).toDF("query_id", "embedding")
    index = pivots.build(vectors, pivots=9)
    for k in (1, 10, 200, 5000):
        assert rows(pivots.search(index, q, k)) == rows(ranking.vector(vectors, q, k))
    assert pivots.search(index, q.limit(0), 3).count() == 0
    assert pivots.search(pivots.build(vectors.limit(0)), q.where("query_id = 51"), 3).count() == 0


def test_skips_what_cannot_be_near(spark):
    index = pivots.build(spark.createDataFrame(clustered(20_000), KIND))
    q = spark.createDataFrame(clustered(10, 1), KIND).toDF("query_id", "embedding")
    assert pivots.share_read(index, q, 10) < 0.25
    first, _, more, two = pivots.rounds(index, q, 10)
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_bad_vectors(spark):
    v = spark.createDataFrame(clustered(30), KIND)
    index = pivots.build(v)
    for bad in ([1.0], [None] * 24):
        with pytest.raises(Exception, match="numbers"):
            pivots.search(index, spark.createDataFrame([(1, bad)], KIND).toDF("query_id", "embedding"), 3).collect()

"""Expansion from stored heads against the expansion over all edges, and hubs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import adjacency, graph

ELEMENTS = "id long, name string, calls array<string>, dependencies array<string>"


def world(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    els = [(i, r.choice([*names, None]), r.choices(names, k=r.randrange(4)) if r.random() < 0.8 else None, r.choices([*names, None], k=r.randrange(3))) for i in range(120)]
    edges = [(r.randrange(130), r.randrange(130), r.choice(["CALLS", "DEPENDS_ON", "INHERITS_FROM"])) for _ in range(400)] + [(0, i, "CALLS") for i in range(120)] * 2
    hits = [(q, n, k, 1.0 / k) for q in range(12) for k, n in enumerate(r.sample(range(0, 140), 7), 1)]
    return (spark.createDataFrame(els, ELEMENTS), spark.createDataFrame(edges, "src long, dst long, rel_type string"), spark.createDataFrame(hits, "query_id long, node_id long, rank int, score double"))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("repeat", [False, True])
def test_equals_expansion_over_edges(spark, seed, repeat):
    els, edges, hits = world(spark, seed)
    adj = adjacency.build(els.repartition(3), edges.repartition(2))
    for most in (7, 9, 30, 200):
        got = sorted(map(tuple, adjacency.expand(hits, adj, seeds=7, most=most, repeat_seeds=repeat).collect()))
        want = sorted(map(tuple, graph.expand_all(hits, els, edges, most=most, repeat_seeds=repeat).collect()))
        assert got == want


def test_more_steps_and_small_heads_go_by_edges(spark):
    els, edges, hits = world(spark, 3)
    adj = adjacency.build(els, edges, head=10)
    for options in ({"depth": 2}, {"most": 40}):
        assert sorted(map(tuple, adjacency.expand(hits, adj, seeds=7, **options).collect())) == sorted(map(tuple, graph.expand_all(hits, els, edges, **options).collect()))


def test_hub_does_not_form_its_pairs(spark):
    n, queries = 200_000, 1000
    els = spark.range(n).select("id", F.lit("all").alias("name"), F.array(F.lit("all")).alias("calls"), F.array().cast("array<string>").alias("dependencies"))
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("CALLS").alias("rel_type"))
    adj = adjacency.build(els, edges)
    assert adj.heads.select(F.max(F.size("head"))).first()[0] == adjacency.HEAD
    hits = spark.range(queries).select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("node_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    assert adjacency.reached(hits, adj, 51).count() == queries * 51
    got = adjacency.expand(hits, adj, seeds=1).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("last")).distinct()
    assert [r[1:] for r in got.select("n", "n", "last").distinct().collect()] == [(50, 49)]
    # No task sees the whole hub: heads are cut before rows of one key meet.
    plan = adjacency.smallest(edges.select((F.col("dst") % 2).alias("way"), (F.col("dst") % 3).alias("key"), F.col("dst").alias("node")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_empty(spark):
    els, edges, hits = world(spark, 4)
    adj = adjacency.build(els.limit(0), edges)
    assert adjacency.expand(hits, adj, seeds=7).where("way > 0").count() == 0
    assert adjacency.expand(hits.limit(0), adjacency.build(els, edges.limit(0)), seeds=7).count() == 0

"""Upkeep of edges against rebuilding them, after random edits."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph import engine, providers, schemas
from corpusgraph.operators import graph, ranking

SCHEMA = "id string, name string, base_classes array<string>, calls array<string>, dependencies array<string>"


def make(r, i):
    names = [f"n{k}" for k in range(30)]
    some = lambda: None if r.random() < 0.1 else r.choices([*names, None], k=r.randrange(4))
    return [f"e{i}", r.choice([*names, None]), some(), some(), some()]


def edit(r, rows):
    out = []
    for row in rows:
        x = r.random()
        if x < 0.1:
            continue
        row = list(row)
        if x < 0.25:
            row[1] = f"n{r.randrange(30)}"
        elif x < 0.4:
            row[r.randrange(2, 5)] = make(r, 0)[2]
        elif x < 0.5 and row[3]:
            row[3] = row[3][::-1] + row[3]  # the same names, in another order and repeated
        out.append(row)
    return out + [make(r, 1000 + r.randrange(1000)) for _ in range(5)]


@pytest.mark.parametrize("seed", range(4))
def test_update_equals_rebuild(spark, seed):
    r = random.Random(seed)
    rows = [make(r, i) for i in range(150)]
    seen, edges = spark.createDataFrame(rows, SCHEMA), None
    edges = graph.build_edges(seen)
    for _ in range(2):
        rows = list({x[0]: x for x in edit(r, rows)}.values())
        now = spark.createDataFrame(rows, SCHEMA).repartition(3)
        edges = graph.update_edges(edges, seen, now)
        assert sorted(map(str, edges.collect())) == sorted(map(str, graph.build_edges(now).collect()))
        seen = now
    assert sorted(map(str, graph.update_edges(edges, seen, seen).collect())) == sorted(map(str, edges.collect()))


def test_little_change_touches_little(spark):
    n = 3000
    rows = [(f"e{i}", f"n{i}", [], [f"n{(i * 7 + k) % n}" for k in range(5)], []) for i in range(n)]
    before = spark.createDataFrame(rows, SCHEMA)
    now = before.withColumn("name", F.when(F.col("id") == "e3", "other").otherwise(F.col("name"))).where("id <> 'e9'")
    sources, targets, added = graph.edge_changes(before, now)
    edges = graph.build_edges(before)
    gone = edges.join(sources, "src", "left_semi").count() + edges.join(targets, "dst", "left_semi").count()
    assert (gone + added.count()) / edges.count() < 0.01


def test_lookup_counts(spark):
    hits = spark.createDataFrame([(1, 1), (2, 1)], "query_id long, node_id long")
    found = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (1, 7)], "query_id long, node_id long")
    store = spark.createDataFrame([(5,), (5,), (9,)], "node_id long")
    assert sorted(map(tuple, graph.lookup_counts(hits, found, store).collect())) == [(1, 1, 2), (2, 0, 0)]


def test_metrics(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "node_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["node_id"], r["score"]) for r in ranking.vector(v, q, 3, "euclidean").orderBy("rank").collect()] == [(3, 1.0), (2, 0.5), (1, round(1 / 21, 6))]
    for f in (lambda: ranking.vector(v, q, 3, "manhattan"), lambda: engine.Settings(metric="manhattan").checked()):
        with pytest.raises(ValueError, match="unknown metric"):
            f()


def test_checked_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert schemas.write_checked(good, path).count() == 2
    with pytest.raises(ValueError, match="exists"):
        schemas.write_checked(good, path)
    for bad in (good.union(good), good.union(spark.createDataFrame([(None, 3)], good.schema))):
        with pytest.raises(ValueError, match="null or repeated"):
            schemas.write_checked(bad, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="missing"):
        schemas.write_checked(good, str(tmp_path / "bad"), schemas.MANIFEST)
    assert not (tmp_path / "bad").exists() and not (tmp_path / "bad.unchecked").exists()


def test_providers_are_registered_once():
    make = providers.Echo
    providers.register_llm("twice")(make)
    providers.register_llm("twice")(make)
    with pytest.raises(ValueError, match="already"):
        providers.register_llm("twice")(lambda: None)
    del providers.LLMS["twice"]

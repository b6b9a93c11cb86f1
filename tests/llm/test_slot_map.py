"""A slot map that lives over several runs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import sharding

SCHEMA = "doc_id long, text string"


def rows(n, size=40, start=0):
    return [(start + i, f"{start + i} " + "x" * (i * 7 % size)) for i in range(n)]


def test_three_runs_edit_one_map(spark, tmp_path):
    root = str(tmp_path / "map")
    run = lambda docs, shards=6: sharding.shard(docs, shards=shards, slots=256, map_path=root).collect()
    versions = lambda: {r["version"]: r["n"] for r in spark.read.parquet(f"{root}/slot_map").groupBy("version").agg(F.count(F.lit(1)).alias("n")).collect()}
    docs = spark.createDataFrame(rows(3000), SCHEMA)
    one = {r["doc_id"]: r["shard"] for r in run(docs)}
    assert versions() == {1: 256, 2: 256}
    two = run(docs)
    assert {r["doc_id"]: r["shard"] for r in two} == one and versions() == {1: 256, 2: 256}  # nothing to move, no version
    more = docs.unionByName(spark.createDataFrame(rows(400, 4000, 10_000), SCHEMA))
    three = run(more)
    assert versions() == {1: 256, 2: 256, 3: 256} and {r["map_version"] for r in three} == {3}
    held = {v: {r["virtual_slot"]: r["shard"] for r in spark.read.parquet(f"{root}/slot_map").where(F.col("version") == v).collect()} for v in (2, 3)}
    moved = sum(held[2][s] != held[3][s] for s in held[2])
    assert 0 < moved < 200
    load = Counter()
    for r in three:
        assert held[3][r["virtual_slot"]] == r["shard"]
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.1 * max(load.values())
    four = run(more, shards=7)
    assert {r["shard"] for r in four} == set(range(7)) and {r["map_version"] for r in four} == {4}
    fewer = run(more, shards=5)
    assert {r["shard"] for r in fewer} == set(range(5)) and sorted(r["doc_id"] for r in fewer) == sorted(r["doc_id"] for r in three)
    for s in range(5):
        places = sorted(r["slot"] for r in fewer if r["shard"] == s)
        assert places == list(range(len(places)))
    with pytest.raises(ValueError, match="another number of slots"):
        sharding.shard(docs, shards=6, slots=128, map_path=root)

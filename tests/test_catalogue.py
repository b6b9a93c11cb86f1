"""Catalogue queries against DuckDB, and rules that SQL on the tables does not reach."""

import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as X
from corpusgraph.operators import evaluate, graph, incremental, ranking
from corpusgraph.operators.running import running_sums
from corpusgraph.plans import catalogue, code_queries, pipelines  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    a, b = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLE[name]).df()
    c = sorted(a.columns)
    assert c == sorted(b.columns)
    rows = lambda d: sorted(map(str, d[c].astype(str).values.tolist()))
    assert rows(a) == rows(b)


def test_fusion_ranks(spark):
    h = spark.createDataFrame([(1, 10, 1, 0.9), (1, 20, 2, 0.8), (1, 10, 3, 0.5)], "query_id long, node_id long, rank int, score double")
    assert [(r[1], r[3]) for r in ranking.rrf([h], 5).orderBy("rank").collect()] == [(10, round(1 / 61, 6)), (20, round(1 / 62, 6))]
    assert ranking.rrf([h], 5, worst_rank=True).orderBy("rank").first()["node_id"] == 20


def test_adaptive_reasons(spark):
    schema = "query_id long, rank int, score double, chars long"
    rows = [(1, 1, 1.0, 40), (2, 1, 9.0, 40), (2, 2, 1.0, 40), (2, 3, 1.0, 40), *((3, k, 1.0, 40) for k in range(1, 16)), *((4, k, 1.0, 40_000) for k in range(1, 16))]
    got = {r["query_id"]: (r["selected_k"], r["stopped_reason"]) for r in ranking.adaptive_k(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (1, "insufficient_candidates"), 2: (2, "probability"), 3: (10, "k_max"), 4: (2, "cost")}


def test_expansion_keeps_seeds_first(spark):
    h = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8)], "query_id long, node_id long, rank int, score double")
    e = spark.createDataFrame([(1, 2, "CALLS"), (3, 1, "DEPENDS_ON"), (2, 4, "INHERITS_FROM")], "src long, dst long, rel_type string")
    assert [(r[1], r[3]) for r in graph.expand(h, e).orderBy("rank").collect()] == [(1, 0.9), (2, 0.8), (3, 0.5)]
    assert graph.expand(h, e, most=1).count() == 1


def test_name_ids(spark):
    for name in ("function:a.b:x.py", "é:ü:日"):
        assert spark.range(1).select(X.name_id(F.lit(name))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_new_version_changes_all(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "path string, mtime long, sha256 string")
    assert incremental.snapshot_diff(m, m).count() == 0
    assert {tuple(r) for r in incremental.snapshot_diff(m, m.where("path = 'a'"), same_version=False).collect()} == {("a", "changed"), ("b", "removed")}


def test_unknown_names_fail(spark):
    with pytest.raises(ValueError, match="known"):
        pipelines.get("nope")


def test_means_keep_ties_in_any_order(spark):
    """40 values that sum to exactly 21.1: the mean 0.5275 is a tie, which sums of doubles would break by their order."""
    values = [0.1] * 11 + [0.7] * 28 + [0.4]
    rows = [(1, v, v, v, v) for v in values]
    for n in (1, 4, 8):
        m = spark.createDataFrame(rows, "k int, precision double, recall double, f1 double, ndcg double").repartition(n)
        assert evaluate.by_k(m).first()["precision"] == 0.528


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_running_sums(spark, parts):
    rows = [(i, None if i % 7 == 0 else i * i % 11, "clash") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, _range string").repartition(parts)
    got = running_sums(df.select("k", "v"), [F.col("k").desc()], {"s": F.col("v"), "n": F.lit(1)})
    s = n = 0
    want = []
    for k, v, _ in sorted(rows, reverse=True):
        s, n = s + (v or 0), n + 1
        want.append((k, v, s, n))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert running_sums(df.limit(0).select("k"), [F.col("k")], {"s": F.col("k")}).count() == 0

"""Hops counted without listing their pairs, against listing them; and the query over a hub with many seeds."""

import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import graph
from corpusgraph.plans import catalogue


def listed(seeds, edges, depth):
    near = graph.neighbours(seeds, edges, depth).where("node IS NOT NULL")
    return near.groupBy("seed", "hop").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))


def rows(df):
    return sorted(map(tuple, df.select("seed", "hop", "n", "least", "most").collect()))


def world(spark, seed):
    """Places, many of whose nodes have the same neighbours: leaves of few hubs, full bipartite parts, loops, and loose edges."""
    r = random.Random(seed)
    name = lambda i: f"e{i:03d}"
    edges = [(name(i), name(200 + r.randrange(4)), "CALLS") for i in range(60)]
    edges += [(name(300 + j), name(i), "DEPENDS_ON") for i in range(60, 75) for j in range(1 + i % 3)]
    edges += [(name(a), name(b), "CALLS") for a in range(80, 84) for b in range(80, 84)]  # with loops: each the others' and its own neighbour
    edges += [(name(r.randrange(100)), name(r.randrange(100, 120)), r.choice(["CALLS", "DEPENDS_ON", "INHERITS_FROM"])) for _ in range(25)]
    edges += [edges[3], (name(85), name(85), "CALLS"), (None, name(200), "CALLS"), (name(1), None, "CALLS"), (name(86), name(200), "INHERITS_FROM")]
    seeds = [(name(i),) for i in [*range(0, 100, 1 + seed % 2), 3, 200, 201, 300, 999]] + [(None,)]
    return spark.createDataFrame(seeds, "seed string"), spark.createDataFrame(edges, "src string, dst string, rel_type string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_equals_listing(spark, tmp_path, seed, depth):
    seeds, edges = world(spark, seed)
    got = rows(graph.reach(seeds, edges, depth, path=str(tmp_path)))
    assert got == rows(listed(seeds, edges, depth)) and len(got) > 40
    told = spark.read.parquet(f"{tmp_path}/alike")
    assert told.select("like").distinct().count() < told.count() / 1.5


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_marks_of_other_lists(spark, monkeypatch, parts):
    """Marks that many lists share by chance do no more than keep their seeds apart."""
    weak = lambda: [F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node") % parts).alias("m")]
    monkeypatch.setattr(graph, "_mark", weak)
    seeds, edges = world(spark, 1)
    assert rows(graph.reach(seeds, edges, 2)) == rows(listed(seeds, edges, 2))


def test_empty(spark):
    seeds, edges = world(spark, 1)
    assert graph.reach(seeds.limit(0), edges, 2).count() == graph.reach(seeds, edges.limit(0), 2).count() == 0


def tables(spark, root, customers, suppliers):
    """A copy of the places with other customers and suppliers."""
    for t in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    customers.write.parquet(f"{root}/customer.parquet")
    suppliers.write.parquet(f"{root}/supplier.parquet")
    return str(root)


def test_hub_of_many_seeds(spark, tmp_path):
    """30,000 suppliers of one nation are 900 million pairs, which are not formed in the time given."""
    n, m = 30_000, 10_000
    named = lambda kind, many: spark.range(many).select(F.col("id").alias(f"{kind[0]}_{kind[1:]}key"), F.concat(F.lit(kind), "id").alias(f"{kind[0]}_name"), F.lit(7).alias(f"{kind[0]}_nationkey"))
    sf = tables(spark, tmp_path, named("ccust", m), named("ssupp", n))
    late = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = catalogue.expand_2hop(spark, sf).groupBy("hop", "n", "least", "most").count().collect()
    finally:
        late.cancel()
    ids = sorted([f"customer:{i}" for i in range(m)] + [f"supplier:{i}" for i in range(n)])
    want = [(1, 1, "nation:7", "nation:7", n), (2, n + m - 1, ids[0], ids[-1], n - 1), (2, n + m - 1, ids[0], ids[-2], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows_equal_sql(spark, tmp_path):
    """Keys that are null, repeated, or in two places, and a supplier alone in its nation."""
    customers = [(1, "c", 3), (1, "c", 4), (1, "c", 3), (None, "c", 3), (2, "c", None), (5, "c", 99), (6, None, 5), (None, None, 5)]
    suppliers = [(1, "s", 3), (2, "s", 3), (2, "s", 4), (3, "s", 4), (3, "s", 3), (3, "s", 3), (None, "s", 3), (4, "s", None), (5, "s", 99), (6, "s", 8), (7, None, 9), (8, "s", 9), (9, "s", 5), (10, "s", 5)]
    sf = tables(spark, tmp_path, spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int"), spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int"))
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT seed, hop, n, least, most FROM ({catalogue.ORACLE['expand_2hop']})").fetchall()
    assert rows(catalogue.expand_2hop(spark, sf)) == sorted(want) and len(want) > 12

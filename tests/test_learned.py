"""The fitted scorer against the plain overlap on held-out queries."""

import random

from pyspark.sql import functions as F

from corpusgraph.operators import evaluate, inverted, learned, ranking
from corpusgraph.plans import catalogue, code_queries


def world(spark, seed=1, n=40):
    """Of ten texts with a query's words two have them in their order, near the front; the others have them scattered."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, queries, qrels, hits = [], [], [], []
    for q in range(n):
        asked = r.sample(words, 4)
        queries.append((q, " ".join(asked)))
        for k in range(10):
            node, rest = q * 10 + k, r.choices(words, k=30)
            if k in (3, 7):
                text = rest[:4] + asked + rest[4:]
                qrels.append((q, node))
            else:
                text = rest
                for a in r.sample(asked, len(asked)):
                    text.insert(r.randrange(8, len(text)), a)
            docs.append((node, " ".join(text)))
            hits.append((q, node, k + 1, 1.0))
    make = spark.createDataFrame
    return make(docs, "node_id long, text string"), make(queries, "query_id long, text string"), make(qrels, "query_id long, node_id long"), make(hits, "query_id long, node_id long, rank int, score double")


def ndcg(hits, queries, qrels):
    return evaluate.metrics(hits, queries, qrels, (5,)).agg(F.avg("ndcg")).first()[0]


def test_beats_overlap_on_held_out_queries(spark):
    docs, queries, qrels, hits = world(spark)
    train, held = (lambda df: df.where("query_id % 2 = 0")), (lambda df: df.where("query_id % 2 = 1"))
    model = learned.fit(train(hits), docs, queries, qrels)
    plain = ndcg(ranking.rerank_overlap(held(hits), docs, queries, 5), held(queries), qrels)
    ours = ndcg(model(held(hits), docs, queries, 5), held(queries), qrels)
    assert ours > 0.95 > plain + 0.2, (ours, plain)
    assert learned.fit(train(hits).repartition(7), docs.repartition(3), queries, qrels.repartition(2)).weights == model.weights


def test_odd_rows(spark):
    docs, queries, qrels, hits = world(spark, 2, 4)
    assert learned.fit(hits, docs, queries, qrels.limit(0)).weights == (0.0,) * len(learned.FEATURES)
    odd = docs.unionByName(spark.createDataFrame([(900, None), (901, "")], docs.schema))
    more = hits.unionByName(spark.createDataFrame([(0, 900, 11, 0.0), (0, 901, 12, 0.0), (0, 999, 13, 0.0)], hits.schema))
    model = learned.fit(more, odd, queries, qrels)
    got = model(more, odd, queries, 20).where("query_id = 0")
    assert got.count() == 12 and got.where("node_id > 899").agg(F.min("rank")).first()[0] > 2


def test_on_benchmark_passages(spark):
    """Documents that hold a benchmark item's text are relevant to it."""
    sf = "/root/testdata/sf0.01"
    docs = catalogue._docs(spark, sf)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    qrels = docs.join(F.broadcast(items.withColumnRenamed("text", "passage")), F.contains("text", "passage")).select("query_id", "node_id")
    hits = ranking.ranked(inverted.bm25(docs, items, 20).select("query_id", "node_id", "score"), 20)
    some = qrels.join(hits, ["query_id", "node_id"], "left_semi").select("query_id").distinct()
    model = learned.fit(hits.where("query_id % 2 = 0"), docs, items, qrels)
    held = items.join(some, "query_id", "left_semi").where("query_id % 2 = 1")
    of = hits.join(held, "query_id", "left_semi")
    assert ndcg(model(of, docs, items, 5), held, qrels) >= ndcg(ranking.rerank_overlap(of, docs, items, 5), held, qrels)


def test_query_ranks_held_out_items(spark):
    got = code_queries.rerank_learned(spark, "/root/testdata/sf0.001").collect()
    assert got and {r["query_id"] % 2 for r in got} == {1} and max(r["rank"] for r in got) == 10

"""The stored index against a plain loop over texts, and what its bounds spare."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions.text import tokens
from corpusgraph.operators import inverted


def cut(text):
    return [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 1]


def brute(docs, queries, k, k1=1.5, b=0.75):
    held = [(i, Counter(cut(t))) for i, t in docs if i is not None]
    avgdl = sum(c.total() for _, c in held) / max(len(held), 1)
    df = Counter(w for _, c in held for w in c)
    out = set()
    for q, t in queries:
        scored = []
        for i, c in held:
            s = sum(math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + k1 * (1 - b + b * c.total() / avgdl)) for w in set(cut(t)) if c[w])
            if s > 0:
                scored.append((-round(s, 6), i))
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def corpus(n=6000, seed=3):
    """Most texts hold the frequent words once among many; a few short ones are all about them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = [r.choice(["ab", "cd", "ef", "größe"]) for _ in range(2)] + [f"w{r.randrange(3000)}" for _ in range(r.randrange(5, 30))]
        if 600 < i < 700:
            t = ["ab", "ab", "cd", "cd"] * 3 + [f"w{r.randrange(5)}"]
        rows.append((i, " ".join(t)))
    return rows + [(n, None), (n + 1, ""), (None, "ab"), (n + 2, "Größe x 日本"), (5, rows[5][1]), (n + 3, "zz " * 20_000)]


QUERIES = [(1, "ab cd"), (2, "ab cd ab w3"), (3, None), (4, "nothing-like this"), (5, "größe 日本"), (6, "w1 w2 w3 w4"), (7, "zz"), (8, "")]


@pytest.mark.parametrize(("parts", "small"), [(1, True), (4, True), (3, False)])
def test_equals_a_loop(spark, monkeypatch, parts, small):
    monkeypatch.setattr(inverted, "RANGE", 1024 if parts == 3 else 8192)
    if not small:
        monkeypatch.setattr(inverted, "BROADCAST", 0)
    if parts > 1:
        monkeypatch.setattr(inverted, "ONE_ROUND", 0)
    rows = corpus()
    index = inverted.build(spark.createDataFrame(rows, "node_id long, text string").repartition(parts))
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    for k in (1, 10, 7000):
        got = {(r["query_id"], r["node_id"], r["rank"]) for r in inverted.search(index, q, k).collect()}
        assert got == brute(rows, QUERIES, k)
    assert inverted.search(index, q, None).count() == len(brute(rows, QUERIES, 10**6))
    assert inverted.search(index, q.limit(0), 5).count() == 0


def test_other_parameters_and_empty_table(spark):
    rows, q = corpus(300), spark.createDataFrame(QUERIES, "query_id long, text string")
    docs = spark.createDataFrame(rows, "node_id long, text string")
    got = {(r["query_id"], r["node_id"], r["rank"]) for r in inverted.bm25(docs, q, 5, k1=0.9, b=0.2).collect()}
    assert got == brute(rows, QUERIES, 5, 0.9, 0.2)
    assert inverted.bm25(docs.limit(0), q, 5).count() == 0


def test_blocks_and_ranges_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(inverted, "RANGE", 1024)
    monkeypatch.setattr(inverted, "ONE_ROUND", 0)
    # Texts that are alike stand together, in partitions enough that build does not deal them out anew.
    docs = spark.createDataFrame(corpus(20_000), "node_id long, text string").repartitionByRange(spark.sparkContext.defaultParallelism, "node_id").sortWithinPartitions("node_id")
    index = inverted.build(docs)
    q = spark.createDataFrame([(1, "ab cd"), (2, "ab cd w3")], "query_id long, text string")
    told = inverted.found(index, q, 10).where("query_id IS NULL").agg(F.sum("scored").alias("scored"), F.sum("skipped").alias("skipped")).first()
    asked, small = inverted.asked_terms(index, q)
    ranges = inverted.bounds(index, asked, small).count()
    blocks = ranges * inverted.RANGE / inverted.BLOCK
    # Of all blocks that hold a query term most are never scored: their range or they themselves cannot reach the tenth place.
    assert told["scored"] < 0.3 * blocks, (told, blocks)


def test_search_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame(corpus(200), "node_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    index = inverted.of_table(spark, str(tmp_path / "docs"), stored)
    assert inverted.of_table(spark, str(tmp_path / "docs"), stored) is index
    q = spark.createDataFrame([(1, "ab")], "query_id long, text string")
    plan = inverted.search(index, q, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path / "docs") not in plan and "CartesianProduct" not in plan
    docs.limit(20).write.mode("append").parquet(str(tmp_path / "docs"))
    assert inverted.of_table(spark, str(tmp_path / "docs"), stored) is not index


def test_one_tokeniser(spark):
    text = "".join(map(chr, range(32, 1500))) + " 日本 a b_2 été"
    assert spark.range(1).select(tokens(F.lit(text))).first()[0]

"""Mixing against rounds of dealing by hand, subset sums against all subsets, and rows that are odd."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import mixing


def words(t):
    return len(re.findall(mixing.WORD, t or ""))


def deal(sizes, share=1.5, most=2, weights=mixing.WEIGHTS):
    """Targets by dealing the excess anew until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        got = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if got[s] > most * sizes[s]}
        if not over:
            return got | {s: most * sizes[s] for s in full}
        full |= over


def test_targets(spark, tmp_path):
    r = random.Random(1)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}": r.choice([0, 5, 100, 10_000]) + r.randrange(50) for i in range(n)} | {None: 70, "": 9, "É": 1, "zero": 0}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
        got = {r[0]: (r[1], r[2]) for r in mixing.targets(df, str(tmp_path / str(n))).collect()}
        want = deal(sizes)
        assert {s: x[0] for s, x in got.items()} == sizes
        assert all(got[s][1] == pytest.approx(want[s], abs=1e-6) for s in sizes)
        assert sum(x[1] for x in got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_knapsack_reaches_the_nearest_sum():
    r = random.Random(2)
    for _ in range(300):
        items = [(i, r.randrange(1, 40), r.randrange(1, 4)) for i in range(r.randrange(1, 6))]
        rest = r.randrange(1, 90)
        taken = mixing._knapsack(items, rest)
        assert all(0 < taken[i] <= c for i, _, c in items if i in taken)
        got = sum(s * taken.get(i, 0) for i, s, _ in items)
        sums = {sum(s * n for (_, s, _), n in zip(items, t, strict=True)) for t in itertools.product(*(range(c + 1) for *_, c in items))}
        near = min(abs(s - rest) for s in sums)
        assert abs(got - rest) == near and got == min(s for s in sums if abs(s - rest) == near)


def test_fit_keeps_to_counts_and_budget():
    r = np.random.default_rng(3)
    for _ in range(50):
        sizes = r.choice(5000, int(r.integers(1, 200)), replace=False)
        counts = r.integers(1, 2000, len(sizes))
        total = int((sizes * counts).sum())
        for budget in (0, 1, total // 3, total - 1, total):
            take = mixing.fit(sizes, counts, budget)
            assert (take >= 0).all() and (take <= counts).all()
            assert abs(int((sizes * take).sum()) - budget) <= (0 if 1 in sizes else sizes[sizes > 0].min(initial=5000))
    assert mixing.fit(np.array([100_000, 300_000]), np.array([5, 5]), 290_000).tolist() == [3, 0]
    assert mixing.fit(np.array([10**6, 0]), np.array([3, 9]), 400_000)[0] == 0 and mixing.fit(np.array([10**6]), np.array([3]), 600_000)[0] == 1


def rows_of():
    r = random.Random(4)
    rows = [(i, "w " * r.randrange(0, 25), r.choice(["a", "b", "c", "hot", "hot", "hot", "hot", None, ""])) for i in range(800)]
    rows += [(1000 + i, "five words are in this", "hot") for i in range(2000)]
    return rows + [(None, "x y", "a"), (None, None, None), (7, None, "a"), (3, "", "b"), (5, "r r r", "c"), (5, "r r r", "c"), (5, "r r r", "c"), (9999, "long " * 50_000, "a")]


@pytest.mark.parametrize("small", [True, False])
def test_mix(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "BUCKET", 40)
    rows = rows_of()
    runs = []
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        for c in ("size", "n", "more", "bucket", "target", "_range"):
            df = df.withColumn(c, F.lit("clash"))
        runs.append(sorted(map(str, mixing.mix(df).collect())))
        got = mixing.mix(df).collect()
    assert runs[0] == runs[1]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes, taken, each = defaultdict(int), defaultdict(int), {}
    for _, t, s in rows:
        sizes[s] += words(t)
    want = deal(dict(sizes))
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        each[r["source"]] = r["target"]
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
    for s, t in each.items():
        assert t == pytest.approx(want[s]) and abs(taken[s] - t) <= (1 if s != "a" else 25_001)
    # Of a length some documents are drawn, as many with another seed, but others.
    drawn = [sorted(r["doc_id"] for r in mixing.mix(df, share=0.3, seed=n).where("source = 'hot' AND size = 5 AND copies = 1").collect()) for n in (1, 5)]
    assert 0 < len(drawn[0]) < 2000 and len(drawn[0]) == len(drawn[1]) and drawn[0] != drawn[1]


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r["target"] for r in mixing.mix(blank).collect()] == [0.0, 0.0]


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += words(r["text"])
    want, taken = deal(dict(sizes)), defaultdict(int)
    got = mixing.op13_source_mixing(spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["source"]) for r in got} == {r["doc_id"]: (words(r["text"]), r["source"]) for r in docs} and len(got) == len(docs)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)

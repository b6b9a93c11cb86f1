"""Quantiles by ranges against numpy, hash trees against the full diff."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import hashtree, incremental, quantiles


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "RANGES", 7)  # so that many steps are needed
    r = np.random.default_rng(1)
    groups = {
        "even": r.random(501), "ties": np.repeat([1.0, 2.0, 2.5], [300, 5, 300]), "one": np.array([4.25]), "same": np.full(50, -3.0), "two": np.array([1.0, 2.0]),
        "tail": np.exp(r.normal(size=400) * 12), "signs": np.array([-1.7e308, -1.0, 0.0, 1e-300, 1.7e308]), None: r.normal(size=20).round(1),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("nothing", None)]
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    df = spark.createDataFrame(rows, "g string, v double").withColumn("rank", F.lit("clash")).repartition(parts)
    got = {(r["g"], r["q"]): r["value"] for r in quantiles.quantiles(df, "g", "v", at).collect()}
    with np.errstate(all="ignore"):
        want = {(g, q): float(np.quantile(xs, q)) for g, xs in groups.items() for q in at}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)
    assert quantiles.quantiles(df.limit(0), "g", "v", at).count() == 0


def snapshots(seed, n=400):
    r = random.Random(seed)
    path = lambda: "/".join([r.choice("abc") for _ in range(r.randrange(4))] + [f"f{r.randrange(10**6)}"])
    before = {path(): (r.randrange(9), "x") for _ in range(n)}
    now = dict(before)
    for p in r.sample(sorted(before), 20):
        now.pop(p)
    for p in r.sample(sorted(now), 20):
        now[p] = r.choice([(99, "x"), (now[p][0], "y"), (None, None)])
    return before, now | {path(): (1, "x") for _ in range(10)} | {"new/deep/folder/of/files": (1, "x")}


def frame(spark, files):
    return spark.createDataFrame([(p, *x) for p, x in files.items()], "path string, mtime long, sha256 string")


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_diff_equals_full_diff(spark, tmp_path, seed):
    before, now = (frame(spark, s) for s in snapshots(seed))
    a, b = hashtree.build(before, str(tmp_path / "a")), hashtree.build(now.repartition(3), str(tmp_path / "b"))
    assert sorted(map(tuple, hashtree.diff(a, b).collect())) == sorted(map(tuple, incremental.snapshot_diff(before, now).collect()))
    assert hashtree.diff(b, hashtree.open_tree(spark, str(tmp_path / "b"))).count() == 0
    none = hashtree.build(before.limit(0))
    assert {r["change"] for r in hashtree.diff(none, b).collect()} == {"added"} and {r["change"] for r in hashtree.diff(b, none).collect()} == {"removed"}


def test_diff_follows_the_change(spark):
    files = spark.range(20_000).select(F.concat_ws("/", F.col("id") % 20, F.col("id") % 400, F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("mtime"), F.lit("x").alias("sha256"))
    now = files.withColumn("sha256", F.when(F.col("path").endswith("/777"), "y").otherwise(F.col("sha256")))
    a, b = hashtree.build(files), hashtree.build(now)
    assert [r["folder"] for r in hashtree.unequal_folders(a, b).orderBy("level").collect()] == ["", "17", "17/377"]
    assert [x.count() for x in hashtree.compared(a, b)] == [50, 50]
    assert [tuple(r) for r in hashtree.diff(a, b).collect()] == [("17/377/777", "changed")]

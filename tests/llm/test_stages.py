"""Stages of the pipeline on odd rows: each against brute force, and all in a row."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corpusgraph.llm import pieces, quality

CLASH = ("score", "predicted", "copy", "kept_id", "row", "marks", "in_text", "pieces", "n_pieces")
GOOD = " ".join(f"plain{i}" for i in range(70))
LEAK = " ".join(f"exam{i}" for i in range(60))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with null ids and texts, repeated rows, equal ids, ties, a leak and columns of clashing names; labels; a benchmark."""
    root = tmp_path_factory.mktemp("stages")
    rows, labels = [], []
    for i in range(300):
        w = [f"t{i}x{j}" for j in range(40)]
        rows.append((i, " ".join(f"{x}$$$!!" if i % 4 == 0 else x for x in w)))
        labels.append((i, int(i % 4 != 0)))
    rows += [(500, GOOD), (501, GOOD), (502, f"{GOOD} and more"), (503, f"so {LEAK} on"), (504, None), (505, ""), (None, "lost words without a number"), (506, "one row"), (506, "one row"), (506, "another row of this number")]
    labels += [(None, 1), (700, None), (1, None), (2, 1), (2, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (3, ""), (None, "never found anywhere in here")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def plain(df, *names):
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


def test_quality_keeps_what_the_model_accepts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = cp.keep_quality(spark, docs, sf)
    model, rows = quality.train(docs, labels), docs.collect()
    score = np.concatenate([model.score(quality.features(pa.array([r["text"]], pa.string()))) for r in rows])
    assert plain(kept, *docs.columns) == sorted(repr(tuple(r)) for r, s in zip(rows, score, strict=True) if s >= 0.3)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert {500, 501, 502, 503, None} <= ids and not ids & set(range(0, 300, 4))
    assert cp.keep_quality(spark, docs.limit(0), sf).count() == 0


def test_leaks_go_and_others_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = cp.drop_leaks(spark, docs, sf)
    assert plain(left, *docs.columns) == sorted(repr(tuple(r)) for r in docs.collect() if LEAK not in (r["text"] or ""))
    assert left.schema == docs.schema and cp.drop_leaks(spark, docs.limit(0), sf).count() == 0


def test_encoding_keeps_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = [c for c in docs.columns if c not in ("pieces", "n_pieces")]
    assert plain(cp.encode(spark, docs, sf), *own) == plain(docs, *own) and cp.encode(spark, docs.limit(0), sf).count() == 0


def test_odd_rows_through_all_stages(spark, sf):
    out = cp.run(spark, sf)
    rows = pieces.decode(out).collect()
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"]) for r in rows if r["text"])
    clean = [(i, " ".join(f"t{i}x{j}" for j in range(40))) for i in range(300) if i % 4]
    # Of the copies, the smallest id stays; of one row twice, one; of one id, each text; the leak and what is rejected go.
    assert texts == sorted([*clean, (500, GOOD), (-1, "lost words without a number"), (506, "one row"), (506, "another row of this number")])
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in ("score", "predicted", "copy", "kept_id", "row", "marks", "in_text"))


def test_former_stages_are_removed(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(cp, "shared_dir", lambda _: str(tmp_path))
    assert cp.run(spark, sf).count() > 200
    assert [p.name for p in Path(tmp_path).glob("stage*")] == ["stage3"]

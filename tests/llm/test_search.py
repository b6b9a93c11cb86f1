"""Ranked search against a plain loop, slice arithmetic against integers, and the query against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import search


def terms(text):
    return re.findall(search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    cut = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in cut if c), sum(c.total() for _, c in cut)
    df = Counter(w for _, c in cut for w in c)
    asked = {}
    for q, t in queries:
        if q is not None:
            asked.setdefault(q, set()).update(terms(t))
    out = set()
    for q, wanted in asked.items():
        scored = []
        for i, c in cut:
            m = 50 + (50 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in wanted if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)}
    return out


def docs_of(seed=1):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["Apfel", "ärger", "b2", "x", "Zoo-Zoo", "日本", "it's", "A", "q"]) for _ in range(n))
    rows = [(i, say(r.randrange(0, 30))) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, "Apfel"), (200, None), (201, ""), (202, "\x00\t--"), (203, "apfel " * 5000), (204, say(20_000))]
    return rows + [(i, "same text for a tie apfel") for i in range(300, 360)]


QUERIES = [(1, "Apfel zoo"), (2, "日本, x x X"), (2, "same"), (3, None), (4, "--"), (None, "apfel"), (5, "nothing-here"), (6, "a b2 q it's ärger same text tie zoo 日本"), (-7, "tie")]


@pytest.mark.parametrize(("parts", "block", "k"), [(1, 1 << 24, 5), (3, 300, 5), (2, 4000, 1), (3, 1000, 500)])
def test_equals_brute_force(spark, parts, block, k):
    rows = docs_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("clash")).withColumn("block", F.lit("clash")).repartition(parts)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in search.rank_documents(docs, queries, k, block_bytes=block).collect()]
    assert len(got) == len(set(got)) or k > 5
    assert set(got) == brute(rows, QUERIES, k)


def test_empty_tables(spark):
    docs, queries = spark.createDataFrame(docs_of(), "doc_id long, text string"), spark.createDataFrame(QUERIES, "query_id long, text string")
    assert search.rank_documents(docs.limit(0), queries).count() == 0
    assert search.rank_documents(docs, queries.limit(0)).count() == 0
    assert search.rank_documents(docs.where("text IS NULL"), queries).count() == 0


def test_whole_index_serves_later_queries(spark, tmp_path):
    rows = docs_of(2)
    index = search.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path), block_bytes=2000)
    for q in (QUERIES[:2], QUERIES):
        asked = spark.createDataFrame(q, "query_id long, text string").select("query_id", F.explode(search.query_terms(F.col("text"))).alias("term"))
        assert {tuple(r) for r in search.search(index, asked, 9).collect()} == brute(rows, q, 9)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 2)
    monkeypatch.setattr(search, "BROADCAST", 0)
    rows = docs_of(3)
    many = [(i, "apfel x" if i % 2 else f"zoo {'q' * (i % 3)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = search.rank_documents(docs, spark.createDataFrame(many, "query_id long, text string"), 4, block_bytes=1500)
    assert {tuple(r) for r in got.collect()} == brute(rows, many, 4)


def test_slices_add_and_rank_as_integers():
    r = np.random.default_rng(4)
    for size, many in ((1, 1), (64, 3), (130, 9), (1000, 40)):
        width, total, planes = -(-size // 64), np.zeros(size, np.int64), []
        for _ in range(many):
            docs = np.sort(r.choice(size, max(1, size // int(r.integers(1, 9))), replace=False))
            value = r.integers(1, 1 << int(r.integers(1, 36)), len(docs))
            total[docs] += value
            dense = np.zeros(width * 64, np.int64)
            dense[docs] = value
            words = np.unique(docs >> 6).astype(np.int32)
            bits = int(value.max()).bit_length()
            plane = np.stack([np.packbits(((dense >> b) & 1).astype(np.uint8), bitorder="little").view(np.uint64)[words] for b in range(bits)])
            planes.append((words, plane))
        order = r.permutation(size)
        for k in (1, 7, size, size + 5):
            places, value = search.top_places(search.add_slices(planes, width), order, k)
            want = [i for i in sorted(range(size), key=lambda i: (-total[i], order[i])) if total[i]][:k]
            assert sorted(places.tolist()) == sorted(want) and (total[places] == value).all()


def test_both_tokenisers_agree(spark):
    texts = ["".join(map(chr, range(1, 700))), "Aß Ça-va İstanbul ÀB\u0085c d 😀😀 x1_y2", "", None, " ", "ABC", "\x00a\x7fb"]
    flat, off = search.cut_terms(pa.array(["skipped", *texts])[1:])
    flat = flat.to_pylist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, asked in df.select("i", search.query_terms(F.col("t"))).collect():
        cut = flat[off[i] : off[i + 1]]
        assert cut == terms(texts[i]) and asked == list(dict.fromkeys(cut))


def test_query_equals_sql(spark):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = search.op12_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(search.ORACLE).fetchall())

"""Pairs compared in a large group of near copies grow with its classes, and no link is lost."""

import random

from corpusgraph.llm import neardup


def _group(n: int) -> list[tuple[int, str]]:
    """Copies of one text with one to four words changed; some pairs are similar enough, most are not quite."""
    r = random.Random(4)
    base = [f"word{r.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(len(w)), r.randrange(1, 5)):
            w[k] = f"other{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def _smallest(rows: list[tuple[int, str]]) -> dict[int, int]:
    """By brute force: the smallest id in reach of each."""
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    sets, root = {i: cut(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_each_class_asks_once_a_round(spark, monkeypatch):
    rows = _group(160)
    asked = {}
    near, linked = neardup._Links.near, neardup._Links.linked

    def near_seen(self, pairs):
        asked[f"near{len(asked)}"] = pairs.count()
        return near(self, pairs)

    def linked_seen(self, pairs, name):
        asked[name] = pairs.count()
        return linked(self, pairs, name)

    monkeypatch.setattr(neardup._Links, "near", near_seen)
    monkeypatch.setattr(neardup._Links, "linked", linked_seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, block=32).collect()}
    assert got == _smallest(rows)
    assert 1 < len(set(got.values())) < len(rows) / 4 or len(set(got.values())) == 1
    assert asked and max(asked.values()) <= len(rows), asked


def test_the_pair_shares_most_keys(spark):
    shared = spark.createDataFrame([(5, 1), (5, 1), (5, 2), (7, 3), (7, 2), (1, 5)], "cid long, other long")
    # Of equal counts the smaller one; a pair asked for from both ends is one.
    assert sorted(map(tuple, neardup.closest(shared).collect())) == [(5, 1), (7, 2)]


def test_most_similar_other_of_both_ends():
    a, b, s = (neardup.np.array(x) for x in ([9, 9, 8], [1, 2, 2], [0.8, 0.9, 0.9]))
    cid, other, seen = neardup._best(a, b, s)
    assert list(zip(cid.tolist(), other.tolist(), strict=True)) == [(1, 9), (2, 8), (8, 2), (9, 2)]
    assert seen.tolist() == [0.8, 0.9, 0.9, 0.9]

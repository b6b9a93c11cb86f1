"""The pattern grammar: factors and threats are learned, clauses tell what words alone cannot."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import toxicity as t


@pytest.fixture(scope="module")
def mixed(spark):
    """Insults meant, insults denied or reported (not toxic), threats; labels follow the clause, not the word."""
    r, base = random.Random(11), [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        w = [r.choice(base) for _ in range(30)]
        kind = i % 10
        bad = r.choice(["grumf", "zorgle", "blarg"])
        if kind < 4:
            w[9:9] = [".", "you", "are", bad, "."]
        elif kind == 4 and i % 20 == 4:
            w[9:9] = [".", "he", "did", "not", "say", "you", "are", bad, "."]
        elif kind == 5:
            w[9:9] = [".", "we", "will", "splonk", "you", "."]
        elif kind == 6:
            w[9:9] = [".", "it", "will", "rain", "tonight", "."]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind < 4 or kind == 5)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), dict(rows)


def scores(g, texts):
    return g.score(pa.array(texts)).tolist()


def test_clauses_beat_words_on_held_out_rows(mixed):
    docs, labels, label, text = mixed
    whole, words = t.train(docs, labels), t.train(docs, labels, factor=t.WORDS_ONLY)
    assert {"grumf", "zorgle", "blarg"} <= set(whole.lexicon) == set(words.lexicon)
    assert whole.factor[t.NEGATED] < t.FACTOR[t.NEGATED]  # the sample says that denied insults are none
    held = [i for i in label if zlib.crc32(str(i).encode()) % 5 == 0]
    assert any("did not say" in text[i] for i in held)
    wrong = lambda g: sum((s >= 0.5) != label[i] for i, s in zip(held, scores(g, [text[i] for i in held]), strict=True))
    assert wrong(whole) == 0 < wrong(words)
    said, denied, reported = scores(whole, ["you are grumf .", "he did not say you are grumf .", "according to them you are grumf ."])
    assert denied < 0.5 <= said and reported <= said
    # A negation in another clause changes nothing.
    assert scores(whole, ["not now . you are grumf ."]) == pytest.approx(scores(whole, ["well now . you are grumf ."]))


def test_threats_are_learned_as_such(mixed):
    docs, labels, *_ = mixed
    g = t.train(docs, labels)
    assert "splonk" in g.threats and not {"grumf", "zorgle", "blarg", "rain"} & g.threats
    sums = g.sums(pa.array(["we will splonk you", "you are grumf", "", None]))
    threatening = t.HAS[:, t.BITS.index(t.THREATENED)]
    assert [bool(x[: t.PATTERNS][threatening].any()) for x in sums] == [True, False, False, False]


def test_same_model_at_any_partitioning(mixed):
    docs, labels, *_ = mixed
    a, b = t.train(docs.repartition(1), labels), t.train(docs.repartition(5), labels)
    assert a.lexicon == b.lexicon and a.factor == b.factor and (a.beta == b.beta).all()


def test_factors_stay_where_the_sample_is_silent(mixed):
    docs, labels, *_ = mixed
    plain = t.train(docs.where("text NOT LIKE '% not %'"), labels)
    assert plain.factor[t.NEGATED] == t.FACTOR[t.NEGATED]
    one = t.train(docs, labels.where("toxic = 0"))
    assert one.factor == t.FACTOR and len(set(scores(one, ["a", "you are grumf", ""]))) == 1


def test_pairs_of_words_mark_clauses():
    g = t.Grammar({"grumf": 2.0})
    of = lambda text, bit: bool(g.sums(pa.array([text]))[0][: t.PATTERNS][t.HAS[:, t.BITS.index(bit)]].any())
    assert of("according to some he is grumf", t.REPORTED) and of("far from grumf", t.NEGATED)
    assert not of("according. to some he is grumf", t.REPORTED) and not of("to according grumf", t.REPORTED)
    two = g.sums(pa.array(["so according", "to grumf"]))
    assert not two[1][: t.PATTERNS][t.HAS[:, t.BITS.index(t.REPORTED)]].any()


def test_fit_settles_where_a_few_labels_speak_against_all_others():
    # Toxic texts are rare and have insults, as have five clean ones, and many of them.
    draw, i = np.random.default_rng(0), np.arange(16_500)
    y = (i % 30 == 0).astype(float)
    n = np.where(y == 1, draw.integers(1, 20, len(y)), 0)
    n[1:35:7] = 19
    words = draw.integers(100, 600, len(y))
    x = np.column_stack([np.log1p(7.0 * n), np.log1p(n), np.log1p(100 * n / words), 7.0 * np.ceil(n / 3), np.log1p(n), np.zeros(len(y)), np.zeros(len(y))])
    beta = t.logistic(x, y)
    z = x @ beta[1:] + beta[0]
    q = 1 / (1 + np.exp(-z))
    assert z[y == 1].min() > z[n == 0].max()
    assert np.abs(x.T @ (y - q) - beta[1:]).max() < 1e-4 and abs((y - q).sum()) < 1e-4  # the gradient is gone


def test_held_out_rows_are_ranked_in_spite_of_clean_rows_with_insults(spark):
    r, base = random.Random(5), [f"word{i}" for i in range(200)]
    bad = ["grumf", "zorgle", "blarg", "snerk", "plonk"]
    rows, labels = [], []
    for i in range(3000):
        w = [r.choice(base) for _ in range(r.randrange(40, 150))]
        for _ in range(r.randrange(1, 20) if i % 30 == 0 else 19 if i in (1, 8, 15, 22, 29) else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 30 == 0)))
    g = t.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0 and i > 29]
    s = dict(zip(held, scores(g, [rows[i][1] for i in held]), strict=True))
    assert min(s[i] for i in held if i % 30 == 0) > max(s[i] for i in held if i % 30)

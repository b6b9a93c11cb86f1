"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import chat, decontam, lm, media, neardup, pieces, quality, sharding, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = say(70)
    out = []
    for i in range(n):
        t = say(r.randrange(3, 160))
        if i % 7 == 0:
            t = f"{say(9)} {passage} {say(5)}"
        if i % 9 == 4 and out:
            w = out[-1][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 13 == 5:
            t = out[-1][1]
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, "Only Four words here"), (n + 4, "only four WORDS here"), (n + 5, "x" * 5000 + " é日😀▁ <|im_end|> " + say(3000)), (n + 6, "a b\x0bc\x00d")]
    return out


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, and columns whose names the operators use themselves."""
    rows = [(None, "a b c d e f g"), (None, None), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for c in ("score", "predicted", "pieces", "n_pieces", "decoded", "slot", "shard", "key", "sig", "marks", "part"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    raw = (t or "").encode()
    return (raw.lower() if lower else raw).split()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_pieces(spark, docs, odd, none):
    one = by_id(pieces.decode(pieces.encode(docs)))
    two = by_id(pieces.encode(docs.repartition(1)))
    for i, t in ROWS:
        assert one[i]["decoded"] == (t or "")
        assert one[i]["pieces"] == two[i]["pieces"] and one[i]["n_pieces"] == len(one[i]["pieces"])
    again = by_id(pieces.encode(docs, seed=18))
    assert any(again[i]["pieces"] != one[i]["pieces"] for i, _ in ROWS)
    assert pieces.decode(pieces.encode(odd)).count() == 5 and pieces.encode(none).count() == 0


def test_pieces_follow_the_law():
    lattices, speller = pieces.Lattices(pieces.Vocabulary(pieces.MODEL, 1.0)), pieces.Speller(pieces.MODEL)
    v = lattices.v
    table = {speller.bytes[speller.first[i] :][: speller.size[i]].tobytes().decode("utf-8", "ignore"): (int(i), v.weight[i]) for i in v.ids}

    def ways(w):
        if not w:
            yield (), 1.0
        for k in range(1, len(w) + 1):
            if w[:k] in table:
                for rest, p in ways(w[k:]):
                    yield (table[w[:k]][0], *rest), p * table[w[:k]][1]

    # A rare word keeps its law beside a common one, whose mass is many orders larger.
    n, words = 40_000, (" there", " zqxjzqxj")
    ids, count = lattices.sample([w for w in words for _ in range(n)], pieces.mix(np.arange(2 * n, dtype=np.uint64)))
    ends = np.cumsum(count)
    got = [tuple(ids[a:b].tolist()) for a, b in zip(ends - count, ends, strict=True)]
    for w, mine in zip(words, (got[:n], got[n:]), strict=True):
        law, seen = dict(ways(w)), Counter(mine)
        total = sum(law.values())
        assert set(seen) <= set(law)
        assert all(abs(seen[k] / n - p / total) < 0.012 for k, p in law.items())


def test_lm(spark, docs, odd, none):
    got = by_id(lm.score(docs))
    counts, held = Counter(), lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in ROWS:
        if not held(i):
            counts.update([*words(t, True), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in ROWS:
        w = [*words(t, True), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert lm.score(odd).count() == 5 and lm.score(none).count() == 0


def lm_rows(d, path):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return lm.grouped(d.select("doc_id", "text", held.alias("held_out")), path)


def test_lm_scores_are_the_same_at_any_partitioning(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "GROUP_BYTES", 4000)
    want = None
    for n in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = sorted((r["doc_id"], r["n_known"], r["base_score"], round(r["score"], 4)) for r in lm.score(docs.repartition(n)).collect())
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    one, many = (lm.learn(lm_rows(docs.repartition(n), str(tmp_path / str(n)))) for n in (1, 5))
    assert all((one.w[k] == many.w[k]).all() for k in one.w) and (one.affinity == many.affinity).all() and (one.after == many.after).all()


def test_lm_trains_on_every_window(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(["word"] * (1 + i % 40))) for i in range(50)]
    seen = []
    train = lm.Model.train
    monkeypatch.setattr(lm.Model, "train", lambda self, *a, **k: seen.append(train(self, *a, **k)) or seen[-1])
    told = lm_rows(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "g")).collect()
    batch = lm.pa.RecordBatch.from_pylist([r.asDict() for r in told])
    for _, words, keys in lm._groups([batch]):
        lm._trained(lm.build(["word word"]), 0.01, 1, 0)(words, keys)
    train_texts = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 != 1]
    starts = np.concatenate([[0], np.cumsum([2 + i % 40 for i in train_texts])])
    assert sum(seen[1:]) == len(lm.windows(starts)[0])


def test_lm_spells_words_together_as_alone():
    odd = ["a\u3000", "\u3000b", "\x85", "\xa0\xa0", "x\u2003y", "\x1c", "\u2028z", "'s", "it's", "q" * 3000, "日本", "é", "1st", "--", "\0", "😀", "<|im_end|>"]
    r = random.Random(4)
    words = list(dict.fromkeys([*odd, *("".join(r.choice("ab'1é-日") for _ in range(r.randrange(1, 9))) for _ in range(3000))]))
    alone = [lm.encoder(lm.VOCABULARY).encode_ordinary(" " + w) for w in words]
    for step in (1, 7, 1 << 14):  # with and without spaces of other kinds in a run
        subs, size = lm.spell(words, step=step)
        assert subs.tolist() == [i for x in alone for i in x] and size.tolist() == [len(x) for x in alone]
    subs, size = lm.spell([])
    assert len(subs) == len(size) == 0


def test_lm_encodes_distinct_words_in_few_calls(monkeypatch):
    """Before, every word was a call of its own."""
    calls, real = [], lm.encoder(lm.VOCABULARY)

    class Counted:
        n_vocab, decode_single_token_bytes = real.n_vocab, real.decode_single_token_bytes

        def encode_ordinary(self, text):
            calls.append(text)
            return real.encode_ordinary(text)

    monkeypatch.setattr(lm, "encoder", lambda path: Counted())
    lm.cut(lm.pa.array([" ".join(f"never{i}seen" for i in range(20_000))]))
    assert 0 < len(calls) < 10


def test_lm_window_layers_are_single_products(monkeypatch):
    """Layers see the places of a batch end to end; before, each window was a small product of its own."""
    model = lm.build([CAT] * 5)
    words, _ = lm.cut(lm.pa.array([CAT * 20]))
    rows = model.seen(model.inputs(words), words.starts, *lm.windows(words.starts)[:2])
    _, (x, new, *_, c, y, h, z) = model.forward(rows)
    assert all(t.ndim == 2 and t.flags.c_contiguous for t in (x, new, c, y, h, z)) and len(y) * lm.WINDOW == len(x) * lm.STRIDE


CAT = "the cat sat on the mat and the dog ran to the cat"


def test_lm_chances_sum_to_one():
    model = lm.build([CAT, "a dog sat"] * 10)
    words, known = lm.cut(lm.pa.array([CAT, "a dog sat"] * 10 + ["once"]))
    count = np.bincount(words.code[words.code >= 0], minlength=len(words.size))
    k = model.classes(words)
    mass, seen = (np.bincount(k, x, lm.CLASSES) for x in (count, count > 0))
    mass[lm.END_CLASS] = 21
    rare = lm.rare_chances(mass, seen)
    # After any beginning: all classes' known words and the end, and the words that are spelt.
    places, _ = lm.cut(lm.pa.array([CAT]))
    rows = model.seen(model.inputs(places), places.starts, *lm.windows(places.starts)[:2])
    p, _ = model.forward(rows)
    known_mass = np.array([(count[k == c] - lm.DISCOUNT).sum() / max(mass[c], 1) for c in range(lm.CLASSES - 1)] + [1.0])
    assert np.allclose(p @ known_mass + p @ rare, 1, atol=1e-5)
    # Spelling: after the start and after each subword, chances of all subwords and the stop sum to 1.
    each = 10 ** (model.after[:, model.group] + model.share).clip(-400)
    assert np.allclose(each.sum(1) + 10 ** model.after[:, lm.GROUPS], 1)
    # score() is that law.
    s = model.score(words, count, mass, rare)
    own, open_ = model.chances(words, rare)
    i = int(np.flatnonzero(words.code == known.to_pylist().index("once"))[0])
    of = words.code[i]
    assert np.isclose(10 ** s[i], own[i] * (1 - lm.DISCOUNT) / mass[k[of]] + open_[i] * 10 ** model.spelt(words)[of], rtol=1e-5)
    never = model.score(words, np.where(np.arange(len(count)) == of, 0, count), mass, rare)
    assert abs(never[i] - np.log10(open_[i]) - model.spelt(words)[of]) < 1e-6
    assert np.allclose(s[words.code == -1], np.log10(own[words.code == -1]))


def test_lm_long_words_and_empty_texts():
    model = lm.build([CAT] * 5)
    words, _ = lm.cut(lm.pa.array(["", None, "q" * 30_000, "x"]))
    mass = np.zeros(lm.CLASSES)
    s = model.score(words, np.zeros(len(words.size), int), mass, lm.rare_chances(mass, mass))
    assert np.isfinite(s).all() and len(s) == 6 and s[2] < -1000


def test_lm_is_causal_and_windows_cover():
    model = lm.build([CAT] * 20)
    text = "the cat sat on the mat and the dog ran far away " * 4
    rare = np.full(lm.CLASSES, 0.1)
    words, _ = lm.cut(lm.pa.array([text]))
    part, _ = lm.cut(lm.pa.array([" ".join(text.split()[:20])]))
    assert np.allclose(model.chances(words, rare)[0][:20], model.chances(part, rare)[0][:20], atol=1e-5)  # what follows changes nothing
    _, first, new = lm.windows(words.starts)
    assert new.sum() == len(words.code) and (np.diff(first) == lm.STRIDE).all()


def test_lm_sees_sixteen_places_before_each_window():
    model = lm.build([CAT] * 20)
    text = ("the cat sat on the mat and the dog ran far away " * 8).split()
    far = list(text)
    far[48 - 17] = "to" if text[48 - 17] != "to" else "on"
    a, b = (model.chances(lm.cut(lm.pa.array([" ".join(x)]))[0], np.ones(lm.CLASSES))[0][48] for x in (text, far))
    assert lm.WINDOW >= 32 and a != b


def test_lm_learns_what_the_context_tells():
    r = random.Random(2)
    make = lambda n: [" ".join(r.choice(tongue) for _ in range(60)) for _ in range(n) for tongue in (("the", "cat", "sat", "dog"), ("le", "chat", "est", "une"))]
    model = lm.build(make(200))
    words, _ = lm.cut(lm.pa.array(make(20)))
    own, _ = model.chances(words, np.ones(lm.CLASSES))
    inner = np.arange(len(own)) % 61 > 5
    assert np.log(own[inner]).mean() > np.log([0.12]).mean()  # of eight words, four are in question


def test_lm_gradient():
    model = lm.build(["a b c d"] * 3)
    words, _ = lm.cut(lm.pa.array(["some words to learn from here"]))
    doc, first, new = lm.windows(words.starts)
    rows = model.seen(model.inputs(words), words.starts, doc, first)
    at = first[:, None] + np.arange(lm.STRIDE)
    aim = words.spread(model.classes(words), lm.END_CLASS)
    target, real = aim[np.minimum(at, len(aim) - 1)], np.arange(lm.STRIDE) < new[:, None]
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, g = model.gradient(rows, target, real)
    for name in ("q", "k", "v", "o", "up", "down", "out", "place", "embed"):
        i = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        w = model.w[name]
        w[i] += 1e-5
        up, _ = model.gradient(rows, target, real)
        w[i] -= 2e-5
        down, _ = model.gradient(rows, target, real)
        w[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][i]) < 1e-2 * abs(g[name][i]) + 1e-6, name


def test_decontamination(spark, docs, odd, none):
    item = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness."
    edited = item.replace("worst", "wurst").replace("age of wisdom", "age  of\nwisdm")
    broken = item.replace("best", "finest").replace("times", "days").replace("age", "epoch").replace("worst", "saddest")
    rows = [(1, f"before {item} after"), (2, f"x {edited.upper()} y"), (3, f"no {broken}"), (4, None), (5, ""), (6, item[:40])]
    d = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    b = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    for chars in (1 << 20, 60):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(d, b, block_chars=chars).collect()}
        assert set(got) == {(1, 7), (2, 7)} and got[1, 7]["edits"] == 0 and 0 < got[2, 7]["edits"] <= 6
        assert rows[0][1][got[1, 7]["start"] : got[1, 7]["end"]] == item
    assert sorted(r["doc_id"] for r in decontam.without_leaks(d, b).collect()) == [3, 4, 5, 6]
    assert decontam.leaks(none, b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0
    assert decontam.leaks(odd, b).count() == 0 and decontam.without_leaks(odd, b).count() == 5


def test_leaks_with_seven_to_eight_percent_edits(spark):
    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n - 1)) + "q"
    items, rows, want = [(1, say(95)), (2, say(339)), (3, "shortone"), (4, say(26))], [], {}
    for item, edits, step in ((1, 7, 1), (2, 27, 12), (3, 0, 1), (4, 2, 9)):
        t = list(items[item - 1][1])
        for e in range(edits):  # one replaced word, or edits spread over the item
            t[5 + e * step] = "Z" if step > 1 else "#"
        rows.append((item, f"{say(60)} {''.join(t)} {say(60)}"))
        want[item, item] = edits
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.leaks(d, b).collect()}
    assert got == want
    assert decontam.without_leaks(d, b).count() == 0


def test_bands_equal_a_count_of_all_pairs(monkeypatch):
    """Counted a few shared q-grams at a time, over texts that repeat themselves and overhang the item on both sides."""
    monkeypatch.setattr(decontam, "SOME", 37)
    r = random.Random(6)
    say = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    for _ in range(30):
        base = say(60, "abc")
        items = decontam.index([(1, base), (2, say(40, "ab")), (3, "-" * 90), (4, base[10:50])])
        text = say(r.randrange(20), "ab") + base[r.randrange(10) :] + "-" * r.randrange(150) + say(20, "abc")
        cp = decontam.normalise(text)[0]
        at, span = decontam._hits(items, cp, np.array([0, len(cp)]))
        want = Counter()
        for a, (low, high) in zip(at.tolist(), span.tolist(), strict=True):
            for p in range(low, high):
                i = int(items.item[p])
                half = int(items.budget[i]) + 1
                cell = (a - int(items.place[p])) // half
                want.update([(i, cell * half, cell * half + 2 * half - 1), (i, cell * half - half, cell * half + half - 1)])
        assert sorted(decontam._bands(items, at, span)) == sorted(k for k, n in want.items() if n >= items.bound[k[0]])


def test_repeated_qgrams_take_bounded_memory():
    """A run of 20,000 dashes against an item of 2,000: 40 million shared q-grams, never held at once."""
    items = decontam.index([(1, "-" * 2000), (2, "other words of an item")])
    text = "before " + "-" * 20_000 + " after other words of an item"
    tracemalloc.start()
    got = decontam.matches(items, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert [(i, e) for i, e, _, _ in got if i == 0][0] == (0, 0) and (1, 0, len(text) - 22, len(text)) in got


def test_alignment_equals_full_distance():
    r = random.Random(1)
    for _ in range(60):
        item = np.array([r.randrange(3) for _ in range(30)], np.uint32)
        t = list(item)
        for _ in range(r.randrange(0, 5)):
            t[r.randrange(len(t))] = 9
        if r.random() < 0.5:
            del t[r.randrange(len(t))]
        text = np.array([5] * r.randrange(4) + t + [6] * r.randrange(4), np.uint32)
        d = [[0] * (len(text) + 1)] + [[i + 1] + [0] * len(text) for i in range(len(item))]
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (item[i - 1] != text[j - 1]))
        least = min(d[-1])
        got = decontam.align(item, text, -8, 12, 6)
        assert (got[0] if got else None) == (least if least <= 6 else None)


def test_near_duplicates(spark, docs, odd, none):
    sets = {}
    for i, t in ROWS:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and least[a] > least[b]:
                    least[a] = least[b]
                    changed = True
    got = by_id(neardup.near_duplicates(docs, block=4))
    assert any(k != v for k, v in least.items())
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), least[i], least[i] == i)
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 5 and {(r["doc_id"], r["component_id"]) for r in rows if r["n_shingles"]} == {(None, 1), (1, 1)}
    assert neardup.near_duplicates(none).count() == 0


def test_index_finds_all_within_radius():
    r = np.random.default_rng(0)
    a = r.integers(0, 65536, neardup.SYMBOLS).astype(np.uint16)
    for _ in range(50):
        b = a.copy()
        b[r.permutation(neardup.SYMBOLS)[: neardup.RADIUS]] ^= 1
        batch = neardup.pa.RecordBatch.from_arrays([neardup.pa.array([1, 2]), neardup.pa.array([a.tobytes(), b.tobytes()], neardup.pa.binary())], ["cid", "sig"])
        keys = next(neardup._keys(iter([batch]))).to_pandas()
        assert set(keys[keys.cid == 1].key) & set(keys[keys.cid == 2].key)


def test_chat(spark):
    rows = [(1, 0, "system", "be brief"), *((1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "word " * (k * 7 % 90)) for k in range(1, 30)),
            (2, 0, None, None), (2, 0, "assistant", "<|im_end|>\n<\\|x <|im_start|>user\nhi"), (None, 1, "assistant", "x"), (3, 1, "rôle\nx", "a" * 9000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    w = chat.format_windows(t, budget=200, history=60)
    made = w.collect()
    assert max(r["window"] for r in made) > 3
    assert all(r["formatted"].startswith("<|im_start|>system\nbe brief<|im_end|>\n") for r in made if r["conv_id"] == 1)
    assert any(r["repeated_turns"] > 1 for r in made)
    got = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    for conv in (1, 2, None, 3):
        own = sorted(((k, r or "", x or "") for c, k, r, x in rows if c == conv), key=lambda x: x)
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        target = "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    assert chat.read_back(chat.format_windows(t.limit(0))).count() == 0


def test_sharding(spark, docs, odd, none):
    got = sharding.shard(docs, shards=4).collect()
    size = {i: len((t or "").encode()) + 8 for i, t in ROWS}
    assert {r["doc_id"]: r["size"] for r in got} == size
    assert all(r["text_crc32"] == zlib.crc32((dict(ROWS)[r["doc_id"]] or "").encode()) for r in got)
    for s in range(4):
        mine = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))
    even = spark.createDataFrame([(i, "x" * (i % 50), "", "", 0) for i in range(4000)], SCHEMA)
    load = Counter()
    for r in sharding.shard(even, shards=8).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 60
    assert sharding.shard(odd).count() == 5 and sharding.shard(none).count() == 0


def test_growing_a_map_moves_only_into_the_new_shard(spark, docs):
    stats = sharding.slot_bytes(sharding.records(docs, slots=64), 64)
    old = sharding.initial_map(spark, 4, 64)
    a = {r["virtual_slot"]: r["shard"] for r in old.collect()}
    new = sharding.grow(old, stats, 4).collect()
    assert all(r["shard"] in (a[r["virtual_slot"]], 4) and r["version"] == 2 for r in new) and any(r["shard"] == 4 for r in new)


def test_substrings(spark, docs, odd, none):
    first = {}
    for i, t in ROWS:
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got, lost = by_id(substring.remove_repeats(docs)), 0
    for i, t in ROWS:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        lost += sum(gone)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
        assert got[i]["kept"].encode() == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert sum(s["length"] for s in got[i]["spans"]) == sum(gone)
    assert lost > 0
    assert substring.remove_repeats(odd).count() == 5 and substring.remove_repeats(none).count() == 0


def test_a_passage_in_every_document_is_one_probe_a_slice(spark):
    r = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{r.randrange(10**9)}" for _ in range(i % 40)] + passage + [f"z{r.randrange(10**9)}" for _ in range(3)])) for i in range(5000)]
    parts, h = 7, substring.word_hashes(pa.array(passage))
    block = substring.window_hashes(h, 25)[:1]
    raw, part = substring._low(block, 5).tobytes(), int(substring._share(block, parts)[0])
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "row", "text"])
    slices = list(substring._probes(parts, 50, 25)(iter([batch])))
    open_rows = [x for b in slices for x in b.to_pylist() if x["hashes"] and x["part"] == part]
    held = [x["hashes"][k : k + 5] for x in open_rows for k in range(0, len(x["hashes"]), 5)]
    cut = len(slices) // 2  # each slice gives what is open, then what is settled
    assert 1 <= held.count(raw) <= cut
    settled = [sum(np.frombuffer(x["counts"], "<u4")) for b in slices for x in b.to_pylist() if not x["hashes"]]
    assert sum(settled) == 5000 * 36 and max(settled) < 2 * sum(settled) / parts  # spread over the partitions
    windows = batch.append_column("marks", pa.array([[np.array([i % 40, 1], "<u4").tobytes()] for i, _ in rows]))
    sent = [x for b in substring._around(parts, 50, 25)(iter([windows])) for x in b.to_pylist()]
    # The windows that meet an anchor: of those that start with the passage, all but one a slice are settled.
    assert sum(sum(np.frombuffer(x["counts"], "<u4")) for x in sent if not x["hashes"]) == 5000 - cut
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_removed").collect()
    assert all(g["n_removed"] == (60 if g["doc_id"] else 0) for g in got) and len(got) == 5000


def test_rows_that_share_an_id_lose_their_own_words(spark):
    p, u = " ".join(f"p{i}" for i in range(80)), " ".join(f"u{i}" for i in range(100))
    d = spark.createDataFrame([(1, p), (2, p), (2, u), (2, p)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(d).collect())
    assert got == [(1, 80, 0), (2, 80, 80), (2, 80, 80), (2, 100, 0)]


def test_classes_that_share_an_id_stay_apart(spark):
    p, u, v = (" ".join(f"{c}{i}" for i in range(40)) for c in "puv")
    d = spark.createDataFrame([(1, p), (2, p), (2, u), (3, u + " x"), (1, v), (4, v + " y")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 1, False)]


@pytest.mark.parametrize("budget,history", [(60, 20), (200, 60), (1024, 256), (30, 0)])
def test_windows_keep_to_the_budget(spark, budget, history):
    rnd, rows = random.Random(4), []
    for c in range(30):
        for t in range(rnd.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant"])
            rows.append((c, t, role, " ".join(["word"] * rnd.choice([0, 3, 9, 30, 90]))))
    made = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget, history=history).collect()
    enc = chat.encoder(chat.VOCABULARY)
    count = lambda r, t: len(enc.encode_ordinary(chat.render(r, t)[0]))
    for w in made:
        turns = chat.parse(w["formatted"])
        assert w["tokens"] == sum(count(r, t) for r, t, *_ in turns)
        own = turns[w["repeated_turns"] :]
        system = turns[0][0] == "system"
        alone = len([t for t in own if t[0] != "system"]) <= 1 and w["repeated_turns"] <= system
        assert w["tokens"] <= budget or alone
        again = turns[system : w["repeated_turns"]] if w["window"] > 1 else []
        assert sum(count(r, t) for r, t, *_ in again) <= history
    for c in range(30):
        mine = [r for r in rows if r[0] == c]
        head = mine[:1] if mine[0][2] == "system" else []
        spent = [count(r, t) for _, _, r, t in mine[len(head) :]]
        want = chat.cut_windows(spent, budget, history, sum(count(r, t) for _, _, r, t in head))
        got = sorted((w for w in made if w["conv_id"] == c), key=lambda w: w["window"])
        own = [len(chat.parse(w["formatted"])) - w["repeated_turns"] - (len(head) if i == 0 else 0) for i, w in enumerate(got)]
        assert own == [e - o for _, o, e in want] or (not want and own == [0])


def test_media(spark, docs, odd, none):
    got = by_id(media.features(media.encode(docs)))
    for i, t in ROWS:
        raw = (t or "").encode()
        held = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["error"]) == (len(raw), len(held), hashlib.sha256(held).hexdigest(), None)
        assert r["tail_crc32"] == zlib.crc32(held[-64:])
    assert media.features(media.encode(odd)).count() == 5 and media.features(media.encode(none)).count() == 0
    bad = spark.createDataFrame([(1, b"GIF89a"), (2, None), (3, b"\xff\xd8\xff\xd9")], "doc_id long, media binary")
    assert all(r["error"] for r in media.features(bad).collect())


def test_jpeg_symbol_by_symbol_equals_arrays():
    r = np.random.default_rng(4)
    data = r.integers(0, 256, 64 * 7, dtype=np.uint8).tobytes()
    jpeg = media.Jpeg(media.encode_payload(data))
    assert media.payload(jpeg) == data
    grid, blocks = media._walk(jpeg)
    fast = media.coefficients(media._unpack(jpeg))
    assert np.array_equal(np.array(blocks), fast)
    assert np.array_equal(grid[1].reshape(-1), fast[:, 0])


def test_jpeg_of_other_tables():
    """A grey 16 x 8 image of two flat blocks, coded by hand: DC sizes 0 and 6, ends of block."""
    huff = lambda kind, *symbols: media._segment(0xC4, bytes([kind, 0, len(symbols), *[0] * 14, *symbols]))
    bits = "00" + "00" + "01" + "100000" + "00"  # diff 0; end; size 6, +32; end
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big")
    file = b"".join((b"\xff\xd8", media._segment(0xDB, bytes([0] + [8] * 64)), media._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])),
                     huff(0x00, 0, 6), huff(0x10, 0), media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])), scan, b"\xff\xd9"))
    assert media.thumbnail(media.Jpeg(file)).tolist() == [[128, 160]]


def coded(rows, pad="1"):
    bits = "".join(rows)
    bits += pad * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def size_bits(v):
    k = abs(v).bit_length()
    return k, format(v if v > 0 else v + (1 << k) - 1, f"0{k}b") if k else ""


def table_of(kind, lengths):
    """A table segment of symbols with the given code lengths, and the codes as bits."""
    body, codes, code = [sum(n == k for n in lengths.values()) for k in range(1, 17)], {}, 0
    order = sorted(lengths, key=lambda s: lengths[s])
    for k in range(1, 17):
        for s in (s for s in order if lengths[s] == k):
            codes[s], code = format(code, f"0{k}b"), code + 1
        code <<= 1
    return media._segment(0xC4, bytes([kind, *body, *order])), codes


def colour_jpeg(height, width, seed, restart=0):
    """Three components, luminance at 2 x 2, tables with codes of 2 to 16 bits, written bit by bit; and its coefficients by component."""
    r = random.Random(seed)
    dc, dc_codes = table_of(0, {k: min(2 + k, 16) for k in range(12)})
    used = [0x00, 0xF0, *(run << 4 | k for run in (0, 1, 3, 14) for k in (1, 2, 5))]
    ac, ac_codes = table_of(16, {s: min(2 + i, 16) for i, s in enumerate(used)})
    mw, mh = -(-width // 16), -(-height // 16)
    grid = {1: np.zeros((2 * mh, 2 * mw), int), 2: np.zeros((mh, mw), int), 3: np.zeros((mh, mw), int)}
    scan, rows, blocks, pred = [], [], [], {1: 0, 2: 0, 3: 0}
    for m in range(mw * mh):
        if restart and m and m % restart == 0:
            scan.append(coded(rows) + bytes([255, 0xD0 + (m // restart - 1) % 8]))
            rows, pred = [], {1: 0, 2: 0, 3: 0}
        for c in (1, 2, 3):
            for y, x in ((0, 0), (0, 1), (1, 0), (1, 1)) if c == 1 else ((0, 0),):
                block, k = [r.randrange(-900, 900)] + [0] * 63, 1
                grid[c][(m // mw) * (2 if c == 1 else 1) + y, (m % mw) * (2 if c == 1 else 1) + x] = block[0]
                n, v = size_bits(block[0] - pred[c])
                rows.append(dc_codes[n] + v)
                pred[c] = block[0]
                while k < 64 and r.random() < 0.7:
                    run, n = r.choice((0, 1, 3, 14)), r.choice((1, 2, 5))
                    long = r.random() < 0.1
                    if k + run + 16 * long > 63:
                        break
                    v = r.choice((-1, 1)) * r.randrange(1 << (n - 1), 1 << n)
                    rows.append((ac_codes[0xF0] if long else "") + ac_codes[run << 4 | n] + size_bits(v)[1])
                    k += run + 16 * long
                    block[k] = v
                    k += 1
                if k < 64:
                    rows.append(ac_codes[0])
                blocks.append(block)
    scan.append(coded(rows))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    parts = [b"\xff\xd8", media._segment(0xDB, bytes([0] + [1] * 64)), media._segment(0xC0, frame), dc, ac]
    parts += [media._segment(0xDD, restart.to_bytes(2, "big"))] if restart else []
    return b"".join([*parts, media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), *scan, b"\xff\xd9"]), grid, blocks


@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_in_colour(spark, restart):
    file, grid, blocks = colour_jpeg(40, 70, 3, restart)
    jpeg = media.Jpeg(file)
    got, coefficients = media._walk(jpeg)
    assert coefficients == blocks and all(np.array_equal(got[c], grid[c]) for c in grid)
    small = np.clip(np.rint(grid[1] / 8 + 128), 0, 255).astype(np.uint8)
    assert np.array_equal(media.thumbnail(jpeg), small)
    row = media.features(spark.createDataFrame([(1, file), (2, file[:-40] + b"\xff\xd9")], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert (row[0]["width"], row[0]["height"], row[0]["error"], row[0]["payload_bytes"]) == (70, 40, None, None)
    assert row[0]["thumbnail_sha256"] == hashlib.sha256(small.tobytes()).hexdigest() and row[1]["error"] and row[1]["feature"] is None


def test_jpeg_decoder_is_linear():
    """One interval of many blocks: four times the blocks in well under sixteen times the time."""
    took = []
    for side in (320, 640):
        file, _, blocks = colour_jpeg(side, side, 1)
        began = time.perf_counter()
        assert media._walk(media.Jpeg(file))[1] == blocks
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


def test_media_of_very_long_texts_and_clashing_columns(spark):
    rows = [(1, "é日😀 " * 700_000), (2, "b" * 64), (2, "b" * 64), (None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = plain
    for c in ("media", "raw", "feature", "error", "width", "payload_sha256"):
        clash = clash.withColumn(c, F.lit(7))
    told = lambda df: sorted(map(str, media.features(media.encode(df)).collect()))
    assert told(plain) == told(clash)
    got = by_id(media.features(media.encode(plain)))
    raw = rows[0][1].encode()
    assert got[1]["n_bytes"] == len(raw) and got[1]["payload_sha256"] == hashlib.sha256(media.pad64(raw)).hexdigest() and got[None]["n_bytes"] == 0


def labelled(spark):
    r = random.Random(5)
    base = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 5 == 0
        w = [r.choice(base) for _ in range(40)]
        if bad:
            w = [f"{x}$$$!!" for x in w]
        if rude:
            w[5:5] = ["you", "are", r.choice(["grumf", "zorgle"]), "."]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(not bad), int(rude)))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, none):
    docs, labels = labelled(spark)
    grammar = toxicity.train(docs, labels)
    assert {"grumf", "zorgle"} <= set(grammar.lexicon)
    got = by_id(toxicity.classify(docs, grammar))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i]["score"] >= 0.5) == (i % 5 == 0) for i in held)
    assert got[900]["score"] == got[901]["score"] < 0.5
    assert toxicity.classify(odd, grammar).count() == 5 and toxicity.classify(none, grammar).count() == 0
    assert toxicity.classify(docs, toxicity.train(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_grammar_marks_clauses():
    s = toxicity
    marks = lambda *symbols: [c[0] for c in s.clauses(list(symbols), [1.0 if x in (s.INSULT, s.THREAT) else 0.0 for x in symbols])]
    assert marks(s.INSULT) == [s.INSULTED]
    assert marks(s.TARGET, s.NEGATION, s.INSULT, s.END, s.INSULT) == [s.INSULTED | s.NEGATED | s.AIMED, s.INSULTED]
    assert marks(s.REPORT, s.THREAT) == [s.THREATENED | s.REPORTED]
    assert marks(s.INSULT, s.NEGATION) == [s.INSULTED] and marks(s.TARGET, s.END) == []


def test_quality(spark, odd, none):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    got = by_id(quality.classify(docs, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert got[900]["score"] == got[901]["score"]
    assert quality.classify(odd, model).columns == [*[c for c in odd.columns if c not in ("score", "predicted")], "score", "predicted"]
    assert quality.classify(odd, model).count() == 5 and quality.classify(none, model).count() == 0
    assert quality.classify(docs, quality.train(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    leak = docs.where("doc_id = 7").first()["text"]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [c for c in out.columns] == ["doc_id", "text", "lang", "source", "n_chars", "pieces", "n_pieces"]
    kept = by_id(pieces.decode(out))
    assert 7 not in kept and len(kept) > 250 and all(r["decoded"] == (r["text"] or "") for r in kept.values())


def test_stages_on_odd_tables(spark, docs):
    """Near-dedup and substring dedup against brute force on rows that share ids, repeat, lack ids or texts, with an extra column."""
    import corpus_pipeline as cp

    p, u, q = (" ".join(f"{c}{i}" for i in range(80)) for c in "puq")
    rows = [(1, p, "a"), (2, p, "b"), (2, u, "c"), (2, u, "c"), (3, None, "d"), (4, "", "e"), (None, q, "f"), (5, q + " z", "g"), (6, " ".join([*q.split()[:60], *(f"n{i}" for i in range(60))]), "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("n_chars", F.length("text").cast("long"))
    near = cp.drop_near_duplicates(spark, d, "")
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["kept"]) for r in near.collect()))
    assert got == sorted([(1, p, "a"), (2, u, "c"), (3, "", "d"), (4, "", "e"), (5, q + " z", "g"), (6, rows[8][1], "h")])
    out = {(r["doc_id"], r["kept"]): r["text"] for r in cp.drop_repeated_passages(spark, d, "").collect()}
    tail = " ".join(f"n{i}" for i in range(60))
    # Of 6, the 60 words it shares with 5 go; 2's copy of 1 goes whole; rows without an id or words stay as they are.
    assert out == {(1, "a"): p, (2, "c"): u, (None, "f"): q, (5, "g"): q + " z", (6, "h"): tail, (3, "d"): None, (4, "e"): ""}
    for stage in (cp.drop_near_duplicates, cp.drop_repeated_passages):
        assert stage(spark, d.limit(0), "").count() == 0 and stage(spark, d, "").columns == d.columns


def test_last_stage_decodes_what_it_encodes(spark, docs, monkeypatch):
    import corpus_pipeline

    out = by_id(corpus_pipeline.encode(spark, docs, ""))
    assert {i: r["text"] for i, r in out.items()} == dict(ROWS) and all(r["n_pieces"] == len(r["pieces"]) for r in out.values())
    whole = pieces.encode_texts

    def wrong(*given):
        ids, n = whole(*given)
        return ids[::-1].copy(), n

    monkeypatch.setattr(pieces, "encode_texts", wrong)
    with pytest.raises(Exception, match="do not decode"):
        corpus_pipeline.encode(spark, docs, "").collect()

"""MinHash near-duplicate detection with a multi-index Hamming join.

A document's set is its distinct shingles of five words (fewer words: the whole sequence). Its signature is 64
minima of random linear functions of the shingle hashes, 16 bits of each. Documents with Jaccard similarity 0.75
differ in 16 of 64 symbols on average (standard deviation 3.5). The join finds every pair of signatures that differ
in at most 33: by pigeonhole over 17 chunks some chunk has at most one error, and for each chunk all keys
with one symbol left out are indexed. A pair at 0.75 exceeds 33 with a probability near 1e-6. Candidates whose
signatures differ in more than 33 symbols go; the others are confirmed on full sets.

Equal sets collapse into a class first. Links inside buckets are sought in rounds, so a bucket's pairs are not spelt
out: (1) each class against one of the smallest members of its buckets; (2) each against one of the members drawn by hash,
one a bucket, only across the components found so far, in both that with which it shares most keys; (3) each against the
most similar one across components; (4) whatever pairs across components remain. In (3) and (4) a bucket's members meet in
blocks of bounded size, each pair in the bucket of its first shared key, and the LOW smallest shingle hashes of both sets,
which are the whole of smaller sets, sift the pairs before full sets are compared; of larger sets a pair at the threshold is
lost with a probability below 1e-6. So (1) to (3) compare no more pairs than there are classes, however large a bucket or
however many of them a class lies in, and after (4) every candidate pair either lies in one component or was tested.

Classes go by a hash of their set, so classes that share an id stay apart. Texts are fetched once a round for the classes
of its candidate pairs; the shuffles of a step and tables that nothing reads any more go at once.

Defined results: documents without words or text have an empty set and link with nothing; rows that repeat an id are
documents of their own, told apart by text_hash; null ids: the row's component is the smallest id in reach, or null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, forget, mix, pieces_of, shared_dir, split_words, stored, table, tidy, whole_windows, window_hashes, word_hashes
from .graph import components

SHINGLE, SYMBOLS, CHUNKS = 5, 64, 17
#: Signatures that differ in more symbols are not compared: each of CHUNKS chunks allows one error.
RADIUS = 2 * CHUNKS - 1
#: So many smallest shingle hashes of a set tell apart, before texts are fetched, what cannot reach the similarity.
LOW = 256
NO_HASH = 1 << 32
_DRAW = np.random.default_rng(20240611)
FACTORS = (_DRAW.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) << U64(1)) | U64(1)
OFFSETS = _DRAW.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and the text of each. Texts of fewer words have one shingle: all of them."""
    words, off = split_words(texts, lower=True)
    h, n = word_hashes(words), np.diff(off)
    start, doc = whole_windows(off, k)
    out, of = [window_hashes(h, k)[start]] if len(start) else [], [doc]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            out.append(mix(window_hashes(h, m)[off[:-1][short]] + U64(m)))
            of.append(short)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (np.concatenate(out)[order] if out else np.zeros(0, U64)), of[order]


def _sketch(batches):
    """Set size, 128-bit set fingerprint and signature of each text."""
    for b in pieces_of(batches, 1):
        h, doc = shingles(b.column(1))
        size, one, two = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, U64), np.zeros(b.num_rows, U64)
        sig = np.zeros((b.num_rows, SYMBOLS), np.uint16)
        if len(h):
            # The text's number above 52 bits of hash: one sort makes sets of all texts (a slice has 4096 at most).
            key = np.sort((doc.astype(U64) << U64(52)) | (h >> U64(12)))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            of = (key >> U64(52)).astype(np.int64)
            h = mix(key << U64(12))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            has = of[first]
            size[has] = np.diff(np.append(first, len(of)))
            one[has], two[has] = np.add.reduceat(h, first), np.add.reduceat(mix(h + U64(1)), first)
            least = np.empty((SYMBOLS, len(has)), U64)
            for j in range(SYMBOLS):
                least[j] = np.minimum.reduceat(h * FACTORS[j] + OFFSETS[j], first)
            sig[has] = (mix(least) >> U64(48)).astype(np.uint16).T
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
             pa.array([s.tobytes() for s in sig], pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "set1", "set2", "sig"],
        )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(tidy(_sketch), "doc_id long, text_hash long, n_shingles long, set1 long, set2 long, sig binary")


def _chunks() -> list[np.ndarray]:
    return np.array_split(np.arange(SYMBOLS), CHUNKS)


def _keys(batches):
    """For each chunk and each of its symbols, a key of the chunk's other symbols."""
    for b in batches:
        n = b.num_rows
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(n, SYMBOLS).astype(U64)
        out = []
        for c, chunk in enumerate(_chunks()):
            for i in range(len(chunk)):
                k = np.full(n, c * 8 + i + 1, U64)
                for s in np.delete(chunk, i):
                    k = mix(k * U64(0x9E3779B97F4A7C15) + sig[:, s])
                out.append(k & ~U64(SYMBOLS - 1) | U64(chunk[i]))  # the low bits tell which symbol is left out
        keys = np.stack(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1).view(np.int64))], ["cid", "key"])


def _near(batches):
    """Pairs whose signatures differ in RADIUS symbols at most."""
    for b in batches:
        a, z = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array((a != z).sum(axis=1) <= RADIUS)) for c in b.columns[:2]], ["a", "b"])


def _confirm(percent: int):
    def run(batches):
        for b in pieces_of(batches, 2, limit=2 << 20):
            texts = pa.concat_arrays([b.column(2), b.column(3)]).dictionary_encode()
            h, doc = shingles(texts.dictionary.cast(pa.string()))
            bounds = np.searchsorted(doc, np.arange(len(texts.dictionary) + 1))
            sets = [np.unique(h[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
            code = texts.indices.to_numpy()
            ok = []
            for x, y in zip(code[: b.num_rows], code[b.num_rows :], strict=True):
                s, t = sets[x], sets[y]
                both = len(s) + len(t) - len(np.union1d(s, t))
                ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["u", "v"])

    return run


def _low(batches):
    """The LOW smallest shingle hashes of each text, all of them if there are fewer, in 32 bits."""
    for b in pieces_of(batches, 1):
        h, doc = shingles(b.column(1))
        key = np.unique((doc.astype(U64) << U64(32)) | (h >> U64(32)))
        bounds = np.searchsorted(key, np.arange(b.num_rows + 1).astype(U64) << U64(32))
        low = [key[x : min(y, x + LOW)].astype("<u4").tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.binary()), pa.array(np.diff(bounds) > LOW)], ["cid", "low", "more"])


def _first_key(differs: np.ndarray) -> np.ndarray:
    """The first key that two signatures share, named by the symbol it leaves out (-1: none)."""
    wrong = np.add.reduceat(differs, CHUNK_STARTS, axis=1, dtype=np.int64)[:, CHUNK_OF]
    shared = (wrong == 0) | ((wrong == 1) & differs)
    return np.where(shared.any(axis=1), shared.argmax(axis=1), -1)


def _alike(low: np.ndarray, more: np.ndarray, i: int, other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which others may reach the similarity: certain for whole sets, for larger ones but for five deviations; and the similarity seen."""
    top = np.where(more, low[:, -1], NO_HASH - 1)
    reach = np.minimum(top[other], top[i])
    mine, theirs = low[i], low[other]
    at = np.minimum(np.searchsorted(mine, theirs), LOW - 1)
    inside = theirs <= reach[:, None]
    both = ((mine[at] == theirs) & inside).sum(axis=1)
    union = inside.sum(axis=1) + np.searchsorted(mine, reach, side="right") - both
    p = percent / 100
    slack = np.where(more[other] | more[i], 5 * np.sqrt(p * (1 - p) * union), 0)
    return both + 1 + slack >= p * union, both / np.maximum(union, 1)


def _across(percent: int, best: bool):
    """Near pairs (cid, other) of members of one block pair of a bucket that lie in different components, and the similarity seen.

    A pair that shares several buckets is looked at in one of them, that of its first shared key. best: only each member's most
    similar other.
    """

    def run(batches):
        yield from _across_batches(batches, percent, best)

    return run


def _best(cid: np.ndarray, other: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For both ends of the pairs, the pair with the largest similarity; of equal ones that with the smallest other."""
    cid, other, seen = np.concatenate([cid, other]), np.concatenate([other, cid]), np.concatenate([seen, seen])
    order = np.lexsort((other, -seen, cid))
    order = order[np.diff(cid[order], prepend=cid[order[:1]] - 1) != 0]
    return cid[order], other[order], seen[order]


def _across_batches(batches, percent: int, best: bool):
    for b in batches:
        found: list[tuple[np.ndarray, ...]] = []
        for members, left, right, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            own = key & (SYMBOLS - 1)
            low = np.full((len(members), LOW), NO_HASH, np.int64)
            for m, row in zip(members, low, strict=True):
                held = np.frombuffer(m["low"], "<u4")
                row[: len(held)] = held
            more = np.array([m["more"] for m in members])
            cid = np.array([m["cid"] for m in members])
            root = np.array([m["root"] for m in members])
            block = np.array([m["block"] for m in members])
            sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint16).reshape(-1, SYMBOLS)
            x, y = np.flatnonzero(block == left), np.flatnonzero(block == right)
            here: list[tuple[np.ndarray, ...]] = []
            for i in x:
                other = y[(root[y] != root[i]) & ((y > i) if left == right else True)]
                differs = sig[other] != sig[i]
                other = other[(differs.sum(axis=1) <= RADIUS) & (_first_key(differs) == own)]
                if len(other):
                    may, seen = _alike(low, more, i, other, percent)
                    here.append((np.full(int(may.sum()), cid[i]), cid[other[may]], seen[may]))
            if here:
                pairs = tuple(np.concatenate(c) for c in zip(*here, strict=True))
                found.append(_best(*pairs) if best else pairs)
        cols = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cid", "other", "seen"])


CHUNK_STARTS = np.array([c[0] for c in _chunks()])
CHUNK_OF = np.repeat(np.arange(CHUNKS), [len(c) for c in _chunks()])


def closest(shared: DataFrame) -> DataFrame:
    """Of what each class (cid) shares keys with (other, a row a key), the one it shares most of them with, as a pair (a, b) with a > b.

    A class asks once, however many keys and leads a large group of near copies gives it."""
    told = shared.groupBy("cid", "other").agg(F.count(F.lit(1)).alias("n"))
    best = told.groupBy("cid").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("other"))
    return best.select(F.greatest("cid", "other").alias("a"), F.least("cid", "other").alias("b")).distinct()


class _Links:
    """The tests of candidate pairs of classes, round by round."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int, root: str):
        self.texts, self.classes, self.percent, self.root, self.turn = docs, classes, percent, root, 0

    def near(self, pairs: DataFrame) -> DataFrame:
        c = self.classes
        left = c.select(F.col("cid").alias("a"), F.col("sig").alias("sa"))
        right = c.select(F.col("cid").alias("b"), F.col("sig").alias("sb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(_near), "a long, b long")

    def texts_of(self, cids: DataFrame) -> DataFrame:
        """(cid, text) of one document of each class."""
        c = self.classes.join(cids, "cid", "left_semi").select("cid", F.col("rep").alias("r"), F.col("text_hash").alias("h"))
        t = self.texts
        same = (c["h"] == t["text_hash"]) & c["r"].eqNullSafe(t["doc_id"])
        return c.join(t, same).select("cid", "text").dropDuplicates(["cid"])

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough, as (u, v)."""
        at = f"{self.root}/{name}"
        pairs = stored(pairs, f"{at}-pairs")
        cids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        texts = stored(self.texts_of(cids), f"{at}-texts")
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("cid").alias(side), F.col("text").alias(f"t{side}")), side)
        out = stored(pairs.select("a", "b", "ta", "tb").mapInArrow(tidy(_confirm(self.percent)), "u long, v long"), at)
        forget(self.texts.sparkSession, f"{at}-pairs", f"{at}-texts")
        return out


def near_duplicates(docs: DataFrame, *, percent: int = 75, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id)."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    made = stored(sketches(docs, id_col, text_col), f"{root}/sketches")
    classes = made.where("n_shingles > 0").groupBy("set1", "set2").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "sig")).alias("least")
    )
    classes = stored(classes.select(F.xxhash64("set1", "set2").alias("cid"), "rep", "set1", "set2", "least.text_hash", "least.sig"), f"{root}/classes")
    links = _Links(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")), classes, percent, root)

    keys = classes.select("cid", "sig").mapInArrow(tidy(_keys), "cid long, key long")
    shared = keys.groupBy("key").agg(F.min("cid").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stored(keys.join(shared, "key").select("key", "cid", "lead"), f"{root}/members")
    star = closest(member.where("cid <> lead").select("cid", F.col("lead").alias("other")))
    edges = links.linked(links.near(star), "edges1")
    found = components(edges, f"{root}/found1")

    rooted = lambda m, f: m.join(f.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    open_keys = lambda m: m.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.struct(F.xxhash64("cid", "key").alias("h"), "cid", "root")).alias("lead2"), F.count(F.lit(1)).alias("n")).where("r1 <> r2")
    member = rooted(member.select("key", "cid"), found)
    member = stored(member.join(open_keys(member).select("key", "lead2"), "key"), f"{root}/open1")
    forget(spark, f"{root}/members")
    star = closest(member.where("root <> lead2.root").select("cid", F.col("lead2.cid").alias("other")))
    edges = edges.unionByName(links.linked(links.near(star), "edges2"))
    found = components(edges, f"{root}/found2")

    member = rooted(member.select("key", "cid"), found)
    member = stored(member.join(open_keys(member).select("key", "n"), "key"), f"{root}/open2")
    forget(spark, f"{root}/open1")
    low = stored(links.texts_of(member.select("cid").distinct()).mapInArrow(tidy(_low), "cid long, low binary, more boolean"), f"{root}/low")

    def across(member: DataFrame, best: bool) -> DataFrame:
        # Members of a large bucket are dealt into blocks; every two blocks meet in a group of bounded size.
        blocks = F.ceil(F.col("n") / block).cast("int")
        member = member.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
        meets = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("block", j).alias("left"), F.greatest("block", j).alias("right"))))
        member = member.join(classes.select("cid", "sig").join(low, "cid"), "cid").select("key", "cid", "root", "block", "sig", "low", "more", meets.alias("at"))
        met = member.groupBy("key", "at.left", "at.right").agg(F.collect_list(F.struct("cid", "root", "block", "sig", "low", "more")).alias("members"))
        return met.select("members", "left", "right", "key").mapInArrow(tidy(_across(percent, best)), "cid long, other long, seen double")

    pairs = across(member, True).groupBy("cid").agg(F.max_by("other", F.struct("seen", -F.col("other"))).alias("other"))
    nearest = stored(pairs.select(F.greatest("cid", "other").alias("a"), F.least("cid", "other").alias("b")).distinct(), f"{root}/nearest")
    if not nearest.isEmpty():
        edges = edges.unionByName(links.linked(nearest, "edges3"))
        found = components(edges, f"{root}/found3")
        member = rooted(member.select("key", "cid"), found)
        member = stored(member.join(open_keys(member).select("key", "n"), "key"), f"{root}/open3")
        forget(spark, f"{root}/open2")
        pairs = across(member, False).select(F.greatest("cid", "other").alias("a"), F.least("cid", "other").alias("b")).distinct()
        pairs = stored(pairs.join(nearest, ["a", "b"], "left_anti"), f"{root}/across")
        forget(spark, f"{root}/open3")
        if not pairs.isEmpty():
            edges = edges.unionByName(links.linked(pairs, "edges4"))
            found = components(edges, f"{root}/found4")
    forget(spark, f"{root}/open2", f"{root}/low")

    of_class = rooted(classes.select("cid", "rep", "set1", "set2"), found)
    # Only components of more than one class need their smallest id looked up.
    least = of_class.join(found.select(F.col("v").alias("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    of_class = of_class.join(least, "root", "left").select("set1", "set2", F.coalesce("least", "rep").alias("component_id"))
    linked = made.where("n_shingles > 0").join(of_class, ["set1", "set2"])
    alone = made.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = linked.unionByName(alone, allowMissingColumns=True).select("doc_id", "text_hash", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")

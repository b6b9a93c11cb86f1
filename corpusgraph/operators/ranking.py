"""Ranking operators. A hits frame has query_id, node_id, rank (from 1) and score; ties break by node_id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Scores are compared after rounding, so that summation order cannot swap ranks.
PLACES = 6
#: Rows of a pack, which meets queries as one.
PACK = 2048
#: The most bytes of queries that are broadcast at once.
BROADCAST = 64 << 20


def ranked(scored: DataFrame, k: int | None = None, score: Column | None = None) -> DataFrame:
    """Rank (query_id, node_id, score) by score; the first k of each query."""
    s = scored.withColumn("score", F.round(F.col("score") if score is None else score, PLACES))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    out = s.withColumn("rank", F.row_number().over(w))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select("query_id", "node_id", "rank", "score")


def _meet(packs: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Every pack with every block of queries. Blocks are broadcast up to BROADCAST bytes; beyond that they go in parts of
    that size, with a scan of the packs for each."""
    many = max(1, -(-size // BROADCAST))
    part = F.pmod(F.xxhash64(blocks.columns[0]), F.lit(many))
    met = [packs.crossJoin(F.broadcast(blocks if many == 1 else blocks.where(part == i))) for i in range(many)]
    return reduce(DataFrame.unionByName, met)


_HITS = "query_id long, node_id long, score double"
_HIT_NAMES = ["query_id", "node_id", "score"]


def _best(score: np.ndarray, key: np.ndarray, k: int | None) -> np.ndarray:
    """Places of the k highest scores, all that tie at the last place included; the smallest keys decide later."""
    if k is None or k >= len(score):
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    top = np.flatnonzero(score >= least)
    return top[np.lexsort((key[top], -score[top]))[:k]]


class _Kept:
    """A task's best of each query so far, put out when they have grown."""

    def __init__(self, k: int | None):
        self.k, self.rows, self.n = k, [], 0

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray):
        self.rows.append((query, key, score))
        self.n += len(query)
        if self.n > 1_000_000:
            self.cut()
            if self.n > 500_000:
                yield self.out()

    def cut(self) -> None:
        q, d, s = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        if self.k is not None:
            first = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
            turn = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            q, d, s = (x[turn < self.k] for x in (q, d, s))
        self.rows, self.n = [(q, d, s)], len(q)

    def out(self) -> pa.RecordBatch:
        if len(self.rows) > 1:
            self.cut()
        rows, self.rows, self.n = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows[0]], _HIT_NAMES)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _pack_vectors(batches):
    """Vectors in packs of PACK rows, as ids and one matrix; all in a pack must be of one length."""
    for whole in batches:
        for a in range(0, whole.num_rows, PACK):
            part = whole.slice(a, PACK)
            size = np.unique(pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
            if len(size) > 1:
                raise ValueError(f"vectors of {', '.join(map(str, size))} numbers in one table")
            flat = part.column(1).flatten()
            if flat.null_count:
                raise ValueError("a vector has a null among its numbers")
            row = part.column(0).to_numpy().astype("<i8").tobytes(), flat.to_numpy().astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in row), pa.array([int(size[0])], pa.int32())], ["ids", "flat", "size"])


METRICS = ("cosine", "euclidean")


def similarities(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Each query against each vector: their cosine (0 with a vector of zeros), or 1 / (1 + squared distance)."""
    if metric == "cosine":
        return _unit(queries) @ _unit(vectors).T
    if metric == "euclidean":
        return 1 / (1 + np.stack([((vectors - q) ** 2).sum(axis=1) for q in queries]))
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def _vectors_best(k: int | None, metric: str):
    def run(batches):
        kept = _Kept(k)
        for batch in batches:
            for ids, flat, size, qids, qflat, qsize in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size != qsize:
                    raise ValueError(f"queries of {qsize} numbers against vectors of {size}")
                key, query = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                matrix = lambda x: np.frombuffer(x, "<f8").reshape(-1, max(size, 1))  # noqa: B023, E731
                score = np.round(similarities(matrix(qflat), matrix(flat), metric), PLACES) if size else np.zeros((len(query), len(key)))
                for i in range(len(query)):
                    top = _best(score[i], key, k)
                    yield from kept.add(np.full(len(top), query[i]), key[top], score[i, top])
        if kept.rows:
            yield kept.out()

    return run


def vector(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Top-k by similarity of vectors (node_id, embedding) for queries (query_id, embedding), exact; in one scan, if the queries take BROADCAST bytes
    at most.

    Both sides are packed; each pack of vectors meets each block of queries, and a task gives its own k best of each
    query. Null vectors and queries take no part; a vector of zeros has cosine 0; vectors of different lengths are an error.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    rows = lambda df, key: df.where("embedding IS NOT NULL").select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    packs = rows(vectors, "node_id").mapInArrow(_pack_vectors, "ids binary, flat binary, size int")
    blocks = rows(queries, "query_id").mapInArrow(_pack_vectors, "ids binary, flat binary, size int").toDF("qids", "qflat", "qsize")
    size = queries.agg(F.sum(8 * (1 + F.size("embedding")))).first()[0] or 0
    return ranked(_meet(packs, blocks, size).mapInArrow(_vectors_best(k, metric), _HITS), k)


def cutoff(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("score") >= least)


def rrf(lists: list[DataFrame], k: int, *, k_rrf: int = 60, worst_rank: bool = False) -> DataFrame:
    """Reciprocal rank fusion; a node that a list repeats counts with its best rank (its worst, if asked)."""
    pick = F.max if worst_rank else F.min
    one = [h.groupBy("query_id", "node_id").agg(pick("rank").alias("rank")) for h in lists]
    every = one[0]
    for h in one[1:]:
        every = every.unionByName(h)
    return ranked(every.groupBy("query_id", "node_id").agg(F.sum(F.lit(1.0) / (k_rrf + F.col("rank"))).alias("score")), k)


def rerank_overlap(hits: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Offline stand-in for a cross-encoder: the share of the query's distinct terms that the text has."""
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    # Only texts that were hit are cut.
    d = docs.join(hits.select("node_id").distinct(), "node_id", "left_semi").select("node_id", F.array_distinct(tokens(F.col("text"))).alias("d"))
    both = hits.select("query_id", "node_id").join(q, "query_id").join(d, "node_id")
    score = F.size(F.array_intersect("q", "d")) / F.greatest(F.size("q"), F.lit(1))
    return ranked(both.select("query_id", "node_id", score.alias("score")), k)


Scorer = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]


def adaptive_k(hits: DataFrame, *, k_min: int = 2, k_max: int = 10, target: float = 0.70, temperature: float = 1.0,
               max_cost: float = 0.01, price: float = 0.001, queries: DataFrame | None = None) -> DataFrame:
    """How many hits to keep: softmax mass, running token cost and the reason to stop, per query.

    hits: query_id, rank, score, chars (length of the text). All in one partition pass by query. With `queries` (query_id),
    those without hits have a row too: none kept, no_candidates.
    """
    q = Window.partitionBy("query_id")
    upto = q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("score") / temperature
    h = hits.withColumn("e", F.exp(s - F.max(s).over(q))).withColumn("p", F.col("e") / F.sum("e").over(q)).withColumn("n", F.count(F.lit(1)).over(q))
    h = h.withColumn("cm", F.sum("p").over(upto)).withColumn("tokens", F.floor((F.sum("chars").over(upto) + F.col("rank") - 1) / 4))
    before = F.coalesce(F.lag("tokens").over(q.orderBy("rank")), F.lit(0))
    h = h.withColumn("over", (before + F.floor(F.col("chars") / 4)) / 1000 * F.lit(price) > max_cost)
    ranged = (F.col("rank") > k_min) & (F.col("rank") <= F.least(F.lit(k_max), F.col("n")))
    mass = F.round("cm", PLACES) >= target
    g = h.groupBy("query_id").agg(
        F.max("n").alias("n"),
        F.max(F.when((F.col("rank") == k_min) & mass, 1).otherwise(0)).alias("early"),
        F.min(F.when(ranged & F.col("over"), F.col("rank"))).alias("ce"),
        F.min(F.when(ranged & mass, F.col("rank"))).alias("pe"),
        F.sort_array(F.collect_list(F.struct("rank", F.round("p", PLACES).alias("p"), F.round("cm", PLACES).alias("cm"), "tokens"))).alias("rows"),
    )
    few, early = F.col("n") <= k_min, F.col("early") == 1
    by_cost = F.col("ce").isNotNull() & (F.col("pe").isNull() | (F.col("ce") <= F.col("pe")))
    last = F.greatest(F.lit(k_min), F.least(F.lit(k_max), F.col("n")))
    kept = F.when(few, F.col("n")).when(early, k_min).when(by_cost, F.col("ce") - 1).when(F.col("pe").isNotNull(), F.col("pe")).otherwise(last)
    reason = (
        F.when(few, "insufficient_candidates").when(early, "probability").when(by_cost, "cost")
        .when(F.col("pe").isNotNull(), "probability").when(last >= k_max, "k_max").otherwise("end")
    )
    g = g.withColumn("selected_k", kept.cast("int")).withColumn("stopped_reason", reason)
    used = F.element_at("rows", F.col("selected_k"))["tokens"]
    out = g.select(
        "query_id", "selected_k", "stopped_reason", used.cast("long").alias("total_tokens"), F.round(used / 1000 * F.lit(price), PLACES).alias("total_cost"),
        F.when(few, F.transform("rows", lambda r: F.round(1 / F.col("n"), PLACES))).otherwise(F.transform("rows", lambda r: r["p"])).alias("probabilities"),
        F.when(few, F.array().cast("array<double>")).otherwise(F.transform("rows", lambda r: r["cm"])).alias("cumulative_masses"),
    )
    if queries is None:
        return out
    none = {"selected_k": F.lit(0), "stopped_reason": F.lit("no_candidates"), "total_tokens": F.lit(0).cast("long"), "total_cost": F.lit(0.0)}
    none |= {c: F.array().cast("array<double>") for c in ("probabilities", "cumulative_masses")}
    every = queries.select("query_id").distinct().join(out, "query_id", "left")
    return every.select("query_id", *(F.coalesce(F.col(c), v).alias(c) for c, v in none.items()))


def select_adaptive(hits: DataFrame, **options) -> DataFrame:
    """The hits that adaptive_k keeps."""
    chosen = adaptive_k(hits, **options).select("query_id", "selected_k")
    return hits.join(chosen, "query_id").where(F.col("rank") <= F.col("selected_k")).drop("selected_k")

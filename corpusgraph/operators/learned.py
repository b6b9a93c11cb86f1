"""Reranking by a pairwise model fitted on relevance judgments.

A hit is described by what its text has of the query: terms, neighbouring terms, their weight by rarity among the hits, how early the first one
stands, how long the text is, and its rank so far. The model is linear; it is fitted by Newton's method so that of two hits of
one query the relevant one scores higher (logistic loss on differences, with a ridge). Each step sums gradient and curvature
over all pairs in Spark and brings FEATURES numbers and their squares to the driver. What is summed are decimals, so the
weights are the same at any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import work
from ..functions.text import tokens
from . import ranking

FEATURES = ("overlap", "weighted", "pairs", "early", "length", "before")
STEPS = 12
RIDGE = 0.01
_EXACT = "decimal(38,12)"


def _neighbours(terms: Column) -> Column:
    """The distinct pairs of terms that stand next to each other."""
    return F.array_distinct(F.zip_with(F.slice(terms, 1, F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, 2, F.greatest(F.size(terms) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def features(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, x) of hits (query_id, node_id, rank) whose query (query_id, text) and document (node_id, text) are known; x holds FEATURES, 0 to 1."""
    q = queries.select("query_id", tokens(F.col("text")).alias("qt"))
    d = docs.join(hits.select("node_id").distinct(), "node_id", "left_semi").select("node_id", tokens(F.col("text")).alias("dt"))
    both = hits.select("query_id", "node_id", "rank").join(q, "query_id").join(d, "node_id")
    both = both.select("query_id", "node_id", "rank", F.size("qt").alias("qn"), F.array_distinct("qt").alias("terms"), F.array_intersect("qt", "dt").alias("common"),
                       F.size(_neighbours(F.col("qt"))).alias("n_pairs"), F.size(F.array_intersect(_neighbours(F.col("qt")), _neighbours(F.col("dt")))).alias("same"),
                       F.size("dt").alias("dn"), "dt")
    # Rarity among the query's own hits: a term that all of them have tells nothing.
    held = both.select("query_id", F.explode("common").alias("t")).groupBy("query_id", "t").agg(F.count(F.lit(1)).alias("df"))
    of_all = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    weight = F.log((F.col("n") + 1) / F.col("df")).cast(_EXACT)
    told = both.select("query_id", "node_id", F.explode("common").alias("t")).join(held, ["query_id", "t"]).join(of_all, "query_id").groupBy("query_id", "node_id").agg(F.sum(weight).alias("w"))
    whole = held.join(of_all, "query_id").groupBy("query_id").agg(F.sum(weight).alias("all_w"))
    every = both.join(told, ["query_id", "node_id"], "left").join(whole, "query_id", "left")
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    first = F.array_position("dt", F.element_at("common", 1))
    x = [part(F.size("common"), F.size("terms")), part(F.col("w"), F.col("all_w")), part(F.col("same"), F.col("n_pairs")),
         F.when(F.size("common") > 0, 1 / F.log2(1 + F.greatest(first, F.lit(1)))).otherwise(0.0), 1 / (1 + F.log(F.lit(1.0) + F.col("dn"))), 1 / F.col("rank")]
    return every.select("query_id", "node_id", F.array(*(F.round(c, 6) for c in x)).alias("x"))


@dataclass(frozen=True)
class Learned:
    """A scorer: the weights of FEATURES. As pipelines.Corpus.scorer it ranks hits by them."""

    weights: tuple[float, ...]

    def __call__(self, hits: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        x = F.col("x")
        score = sum((x[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))
        return ranking.ranked(features(hits, docs, queries).select("query_id", "node_id", score.alias("score")), k)


def differences(judged: DataFrame) -> DataFrame:
    """(x): features of a relevant hit less those of one that is not, for all such pairs of a query, each query with weight one. judged: query_id, x, relevant; a
    query's hits are few, so are its pairs."""
    good = judged.where("relevant").select("query_id", F.col("x").alias("a"))
    bad = judged.where("NOT relevant").select("query_id", F.col("x").alias("b"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return good.join(bad, "query_id").select(F.zip_with("a", "b", lambda a, b: a - b).alias("x"), (1 / n).alias("share"))


def fit(hits: DataFrame, docs: DataFrame, queries: DataFrame, qrels: DataFrame, *, steps: int = STEPS, ridge: float = RIDGE) -> Learned:
    """Weights from hits and the relevant nodes (query_id, node_id) of their queries; a query with no relevant hit or nothing else tells
    nothing, without any that does all weights are 0."""
    judged = features(hits, docs, queries).join(qrels.select("query_id", "node_id").distinct().withColumn("_is", F.lit(True)), ["query_id", "node_id"], "left")
    pairs = work.stored(differences(judged.select("query_id", "x", F.coalesce("_is", F.lit(False)).alias("relevant"))), f"{work.shared_dir(hits.sparkSession)}/pairs")
    m, w = len(FEATURES), np.zeros(len(FEATURES))
    exact = lambda c: F.coalesce(F.sum(c.cast(_EXACT)), F.lit(0)).cast("double")
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    for _ in range(steps):
        x = F.col("x")
        margin = sum((x[i] * float(v) for i, v in enumerate(w)), F.lit(0.0))
        told = pairs.select("x", "share", (1 / (1 + F.exp(margin))).alias("p")).agg(*(exact(x[i] * F.col("p") * F.col("share")) for i in range(m)), *(exact(x[i] * x[j] * F.col("p") * (1 - F.col("p")) * F.col("share")) for i, j in upper)).first()
        gradient, curve = np.array(told[:m]) - ridge * w, ridge * np.eye(m)
        for (i, j), v in zip(upper, told[m:], strict=True):
            curve[i, j] += v
            curve[j, i] = curve[i, j]
        step = np.linalg.solve(curve, gradient)
        w = np.round(w + step, 9)
        if np.abs(step).max() < 1e-7:
            break
    return Learned(tuple(float(v) for v in w))

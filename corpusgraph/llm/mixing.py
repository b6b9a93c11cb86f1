"""Mixing sources to target weights by subset sums.

Documents are counted by source and exact length. A source's target is its share, by weight, of a budget of words; what a
share exceeds `most` times the source's words is dealt to the others by weight. Every document is taken as often whole
as the target holds the source whole; the rest of the target is a subset sum over lengths: of each length the same
part of the documents, then the longest that fit until at most WINDOW words are left, and for these a bounded knapsack
over the lengths that remain, which ends at the nearest sum it can reach. Which documents of a length are taken is decided by a
seeded hash of id and text, so reruns agree at any partitioning.

Only counts are gathered by source: one row for each of its distinct lengths, of which there are no more than the words of
its longest document. Documents of one source and length, of which there may be any number, are dealt into buckets of about BUCKET by
their hash; buckets before the one where the count is reached are taken whole, and only that one is ranked.

Defined results: null and empty texts have no words and are taken with 0; a null source is a source, the last one; null ids and
repeated rows are documents of their own (of equal rows as many are taken as their count says, no matter which); other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running_sums
from .common import shared_dir, stored, table

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: The most words that are left to the knapsack.
WINDOW = 1 << 16
#: Documents of one source and length in a bucket, about.
BUCKET = 512
#: The most pairs of source and length that are broadcast, of some 220 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_DRAW_BITS = 31
SEED = 29


def sized(docs: DataFrame, seed: int, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, draw): words of each document and its seeded number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << _DRAW_BITS))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), draw.alias("draw"))


def targets(sizes: DataFrame, path: str, *, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, none above `most` times its source.

    Sources by code point, null last, have the weights in turn. In order of words a weight, those at their limit come first: one
    is at it if its share of what the ones before leave exceeds it. So running sums stand for rounds of dealing anew.
    """
    counted = running_sums(sizes, [F.asc_nulls_last("source")], {"turn": F.lit(1).cast("long")}, path=f"{path}/turns")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = counted.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    run = running_sums(w, [F.col("limit") / F.col("weight"), F.col("turn")], {"limits": F.col("limit"), "weights": F.col("weight")}, path=f"{path}/limits")
    total = sizes.agg((F.sum("source_size") * share).alias("budget"))
    all_weights = w.agg(F.sum("weight").alias("all_weights"))
    one = run.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_weights))  # one row each
    left, heavy = F.col("budget") - F.col("limits") + F.col("limit"), F.col("all_weights") - F.col("weights") + F.col("weight")
    told = stored(one.withColumn("full", F.col("weight") * left > F.col("limit") * heavy), f"{path}/full")
    rest = told.agg((F.max("budget") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0))).alias("rest"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open"))
    share_of = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.least(F.col("weight") * F.col("rest") / F.col("open"), F.col("limit").cast("double")))
    return told.crossJoin(F.broadcast(rest)).select("source", "source_size", share_of.alias("target"))  # one row


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their sum comes near the budget."""
    sizes, counts = [int(x) for x in sizes], [int(x) for x in counts]
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return np.array(counts, np.int64)
    take = [c * budget // total for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, take, strict=True))
    down = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: -sizes[i])
    for i in down:
        if rest <= WINDOW:
            break
        n = min(counts[i] - take[i], rest // sizes[i])
        take[i] += n
        rest -= n * sizes[i]
    left = [i for i in down if take[i] < counts[i]]
    if rest > WINDOW:  # nothing that is left fits: the shortest, if going over by it is nearer
        if left and sizes[left[-1]] < 2 * rest:
            take[left[-1]] += 1
    elif rest:
        for i, n in _knapsack([(i, sizes[i], counts[i] - take[i]) for i in left], rest).items():
            take[i] += n
    return np.array(take, np.int64)


def _knapsack(items: list[tuple[int, int, int]], rest: int) -> dict[int, int]:
    """Of items (name, size, count) how many to take for the sum nearest to `rest`, the smaller of two as near.

    Counts are split into powers of two. `by` has the first part with which a sum was reached; the sum before it was
    reached with parts before that one, so following it back uses each part once.
    """
    top = 2 * rest - 1
    reached, by, parts = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int32), []
    reached[0] = True
    for name, size, count in items:
        count, power = min(count, top // size), 1
        while count and not reached[rest]:
            n = min(power, count)
            count, power, step = count - n, power * 2, n * size
            fresh = np.flatnonzero(reached[: top + 1 - step] & ~reached[step:]) + step
            reached[fresh], by[fresh] = True, len(parts)
            parts.append((name, n, step))
        if reached[rest]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.lexsort((sums, np.abs(sums - rest)))[0]])
    taken: dict[int, int] = {}
    while at:
        name, n, step = parts[by[at]]
        taken[name] = taken.get(name, 0) + n
        at -= step
    return taken


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target // size) if size else 0
    rows["whole"] = whole
    rows["more"] = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), round(target) - whole * size)
    return rows


def plan(hist: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, size, n, source_size, target, whole, more): how often every document of a source and length is taken, and how many
    of the n once more."""
    rows = hist.join(wanted, hist["source"].eqNullSafe(wanted["source"])).select(hist["source"], "size", "n", "source_size", "target")
    return rows.groupBy("source").applyInPandas(_fit_source, "source string, size long, n long, source_size long, target double, whole long, more long")


def mix(docs: DataFrame, *, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, path: str | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document: copies is how often the mix takes it, 0 to `most`."""
    root = path or shared_dir(docs.sparkSession)
    own = stored(sized(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col).withColumn("source", F.col("source").cast("string")), f"{root}/sized")
    hist = stored(own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), f"{root}/lengths")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    chosen = stored(plan(hist, stored(targets(sizes, root, share=share, most=most, weights=weights), f"{root}/targets")), f"{root}/plan")
    small = chosen.count() <= BROADCAST_ROWS
    of = lambda side: own.join(F.broadcast(side) if small else side, own["source"].eqNullSafe(side["source"]) & (own["size"] == side["size"])).drop(side["source"], side["size"])
    bucket = F.shiftright(F.col("draw") * F.ceil(F.col("n") / BUCKET), _DRAW_BITS).alias("bucket")
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    tally = of(chosen.where(some)).select("source", "size", "more", bucket).groupBy("source", "size", "more", "bucket").agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    cuts = tally.withColumn("upto", upto).where((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("held") < F.col("more")))
    cuts = cuts.select("source", "size", F.col("bucket").alias("cut"), (F.col("more") - F.col("upto") + F.col("held")).alias("within"))
    both = chosen["source"].eqNullSafe(cuts["source"]) & (chosen["size"] == cuts["size"])
    final = stored(chosen.join(cuts, both, "left").drop(cuts["source"], cuts["size"]), f"{root}/cuts")
    told = of(final).select("doc_id", "source", "size", "source_size", "target", "whole", "more", "n", "cut", "within", "draw", bucket)
    edge = F.col("cut").isNotNull() & (F.col("bucket") == F.col("cut"))
    turn = F.row_number().over(Window.partitionBy("source", "size").orderBy("draw", "doc_id"))
    inside = told.where(edge).withColumn("once", (turn <= F.col("within")).cast("int"))
    rest = told.where(~edge).withColumn("once", F.when(F.col("cut").isNull(), F.col("more") == F.col("n")).otherwise(F.col("bucket") < F.col("cut")).cast("int"))
    return inside.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("once")).cast("int").alias("copies"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents mixed by the weights 5, 2, 1 to 150 % of all words."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")

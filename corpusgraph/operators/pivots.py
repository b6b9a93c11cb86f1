"""Exact vector search that skips what the triangle inequality rules out.

Unit vectors are sorted by their nearest pivot and their angle to it and stored in packs, so a pack is a ring round a pivot, with
its least and greatest angle. For a query at angle a to the pivot no vector of the ring [lo, hi] is nearer than the gap between a and
the ring. A search first scores each query's nearest rings, enough for k vectors; the k-th angle so found rules out all rings
with a wider gap, whose vectors are not read. Pivots are a bounded sample (PIVOTS vectors, by hash of id), and any pivots give the
same result; they decide only how much is skipped. Vectors that lie evenly in many dimensions are all about as far
from each other, and nothing can be skipped then: ranking.vector, one scan, is the faster way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import work
from . import ranking

PIVOTS = 64
PACK = 1024
#: Queries that meet a pack at once.
QUERIES = 256
#: Scores tie after rounding to six places, so the k-th angle is widened by what rounding can hide.
ROUNDING, SLACK = 1e-6, 1e-7
_UNITS = "node_id long, pivot int, angle double, flat binary"
_PACKS = "pack long, pivot int, lo double, hi double, n int, ids binary, flat binary"


@dataclass(frozen=True)
class VectorIndex:
    """packs: (pack, pivot, lo, hi, n, ids, flat); pivots: unit vectors, a row each; pivot -1 holds vectors of zeros."""

    packs: DataFrame
    pivots: np.ndarray
    dimension: int
    n: int


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    size = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(size) and (len(size) > 1 or size[0] != dimension):
        raise ValueError(f"vectors of {', '.join(map(str, size))} numbers where {dimension} are expected")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a null among its numbers")
    return ranking._unit(flat.to_numpy().astype(np.float64).reshape(-1, max(dimension, 1)))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _assign(pivots: np.ndarray, dimension: int):
    def run(batches):
        for b in batches:
            unit = _matrix(b.column(1), dimension)
            angle = _angles(unit, pivots) if len(pivots) else np.zeros((len(unit), 1))
            own = angle.argmin(axis=1)
            zero = ~unit.any(axis=1)
            ends = np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1] * 8
            flat = pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(unit.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(zero, -1, own).astype(np.int32)), pa.array(np.where(zero, 0, angle[np.arange(len(unit)), own])), flat], ["node_id", "pivot", "angle", "flat"])

    return run


def _pack(batches):
    """Sorted vectors as rings: successive ones of one pivot, PACK at most."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        pivot, angle = b.column("pivot").to_numpy(), b.column("angle").to_numpy()
        cuts = np.flatnonzero(np.diff(pivot, prepend=pivot[0] - 1)) if len(pivot) else []
        for a, z in zip(cuts, [*cuts[1:], len(pivot)], strict=True):
            for i in range(a, z, PACK):
                j = min(i + PACK, z)
                row = [number], [pivot[i]], [angle[i:j].min()], [angle[i:j].max()], [j - i], [b.column("node_id")[i:j].to_numpy().astype("<i8").tobytes()], [b"".join(b.column("flat")[i:j].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [f.split()[0] for f in _PACKS.split(", ")])
                number += 1


def build(vectors: DataFrame, path: str | None = None, *, pivots: int = PIVOTS) -> VectorIndex:
    """Index vectors (node_id, embedding) by cosine. Null vectors and null ids take no part; all must be of one length."""
    rows = vectors.where("embedding IS NOT NULL AND node_id IS NOT NULL").select(F.col("node_id").cast("long").alias("node_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("node_id"), "node_id").limit(pivots).select("embedding").collect()], np.float64)  # a bounded sample
    dimension = drawn.shape[1] if drawn.ndim == 2 else 0
    unit = ranking._unit(drawn) if dimension else np.zeros((0, 1))
    unit = unit[unit.any(axis=1)]
    told = rows.mapInArrow(_assign(unit, dimension), _UNITS).repartitionByRange("pivot", "angle", "node_id").sortWithinPartitions("pivot", "angle")
    packs = work.stored(told.mapInArrow(_pack, _PACKS), f"{path or work.shared_dir(vectors.sparkSession)}/packs")
    return VectorIndex(packs, unit, dimension, packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _look(index: VectorIndex):
    """Each query's unit vector with its angle to every pivot."""
    pivots, dimension = index.pivots, index.dimension

    def run(batches):
        for b in batches:
            unit = _matrix(b.column(1), dimension)
            angle = np.hstack([np.full((len(unit), 1), np.pi / 2), _angles(unit, pivots)]) if len(pivots) else np.full((len(unit), 1), np.pi / 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(angle.tolist(), pa.list_(pa.float64()))], ["query_id", "unit", "angles"])

    return run


def _best(k: int):
    def run(batches):
        kept = ranking._Kept(k)
        for b in batches:
            for ids, flat, askers in zip(*(b.column(c).to_pylist() for c in ("ids", "flat", "askers")), strict=True):
                key, query = np.frombuffer(ids, "<i8"), np.array([x["query_id"] for x in askers])
                rows = lambda x, n: np.frombuffer(x, np.float64).reshape(n, -1)
                score = np.round(rows(b"".join(x["unit"] for x in askers), len(query)) @ rows(flat, len(key)).T, ranking.PLACES)
                for i in range(len(query)):
                    top = ranking._best(score[i], key, k)
                    yield from kept.add(np.full(len(top), query[i]), key[top], score[i, top])
        if kept.rows:
            yield kept.out()

    return run


def _score(index: VectorIndex, pairs: DataFrame, asked: DataFrame, k: int, groups: int) -> DataFrame:
    """The pairs (query_id, pack): vectors of a pack with the queries that want it, QUERIES at once about."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    askers = pairs.join(asked.select("query_id", "unit"), "query_id").groupBy("pack", part.alias("part")).agg(F.collect_list(F.struct("query_id", "unit")).alias("askers"))
    return index.packs.select("pack", "ids", "flat").join(askers, "pack").mapInArrow(_best(k), ranking._HITS)


def rounds(index: VectorIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(first pairs, their hits, further pairs, their hits): pairs are (query_id, pack, n)."""
    root = work.shared_dir(queries.sparkSession)
    q = queries.where("embedding IS NOT NULL AND query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = work.stored(q.mapInArrow(_look(index), "query_id long, unit binary, angles array<double>"), f"{root}/asked")
    groups = max(1, -(-asked.count() // QUERIES))
    at = asked.select("query_id", F.posexplode("angles").alias("pivot", "angle")).withColumn("pivot", F.col("pivot") - 1)
    gap = F.when(F.col("pivot") < 0, F.col("angle")).otherwise(F.greatest(F.lit(0.0), F.col("lo") - F.col("angle"), F.col("angle") - F.col("hi")))
    gaps = work.stored(at.join(index.packs.select("pack", "pivot", "lo", "hi", "n"), "pivot").select("query_id", "pack", "n", gap.alias("gap")), f"{root}/gaps")
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("gap", "pack").rowsBetween(Window.unboundedPreceding, -1))
    first = work.stored(gaps.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).select("query_id", "pack", "n"), f"{root}/first")
    one = work.stored(_score(index, first, asked, k, groups), f"{root}/hits")
    last = ranking.ranked(one, k).groupBy("query_id").agg(F.min("score").alias("least"))
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") - ROUNDING))) + SLACK
    more = gaps.join(first, ["query_id", "pack"], "left_anti").join(last.select("query_id", reach.alias("reach")), "query_id").where("gap <= reach").select("query_id", "pack", "n")
    return first, one, more, _score(index, more, asked, k, groups)


def search(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """Cosine top-k for queries (query_id, embedding), as ranking.vector gives it; queries of one id are not expected."""
    _, one, _, two = rounds(index, queries, k)
    return ranking.ranked(one.unionByName(two), k)


def share_read(index: VectorIndex, queries: DataFrame, k: int) -> float:
    """The part of all pairs of query and vector that a search scores."""
    first, _, more, _ = rounds(index, queries, k)
    n, of = first.unionByName(more).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("query_id")).first()
    return n / max(1, of * index.n)

"""A stored inverted index for BM25 with exact dynamic pruning.

Documents are numbered inside ranges of RANGE. A row of the index holds one term's documents of one range, what each gives to
a score before the term's weight, and the highest such contribution of each block of BLOCK documents and of the row. The table is bucketed
and sorted by term, so a join with terms moves none of it; a frequent term has a row for each range, so it is
spread over tasks. The texts are read once, when the index is built.

A search first bounds every pair of query and range by its terms' highest contributions, reading no postings. The most promising
range of each query is scored; its k-th score is a floor for that query. Only ranges whose bound reaches the floor are scored
then, in them only blocks whose own bound does, the most promising ones first, and each task raises the floor by its own k-th
score as it goes. Where ranges are few, all are scored in one round, with floors of each task's own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import work
from ..functions.text import tokens
from . import ranking

#: Documents of a range, 32,767 at most; a rare term's row costs more than its documents, so ranges are wide.
RANGE = 8192
BLOCK = 64
#: A bound counts as reaching a floor that it misses by less; scores are compared after rounding to six places.
SLACK = 1e-5
#: Up to so many ranges for each core are scored in one round: finding floors first would take longer.
ONE_ROUND = 4
#: The most bytes of query terms that are broadcast; more are joined by shuffle.
BROADCAST = 16 << 20
_PACKS = "range long, term string, df long, size long, docs binary, tfs binary, sizes binary"
_ROWS = "range long, term string, df long, high double, docs binary, parts binary, blocks binary, highs binary"
_FOUND = "query_id long, node_id long, score double, scored long, skipped long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


@dataclass(frozen=True)
class TextIndex:
    """postings: the rows; ids: (range, ids) of so many ranges; terms: (term, df); n and avgdl: number and mean length of documents."""

    postings: DataFrame
    ids: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    ranges: int


def _cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _pack(batches):
    """Ranges of tokenised documents: a row for each term; under the empty term, which no document has, ids and totals."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for a in range(0, whole.num_rows, RANGE):
            part = whole.slice(a, RANGE)
            n = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int32)
            coded = part.column(1).flatten().dictionary_encode()
            pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * RANGE + np.repeat(np.arange(len(n)), n), return_counts=True)
            term, doc = pair // RANGE, pair % RANGE
            at = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
            ids = part.column(0).to_numpy().astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([number], [""], [len(n)], [int(n.sum())], [ids], [b""], [b""]), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], _names(_PACKS))
            if len(term):
                same = [pa.array(np.full(len(at) - 1, number)), coded.dictionary, pa.array(np.diff(at)), pa.array(np.zeros(len(at) - 1, np.int64))]
                yield pa.RecordBatch.from_arrays([*same, _cut(doc.astype(np.int16), at), _cut(tf.astype(np.int32), at), _cut(n[doc], at)], _names(_PACKS))
            number += 1


def _weigh(avgdl: float, k1: float, b: float):
    """Packs with contributions in place of frequencies and lengths, and the highest of each block."""

    def run(batches):
        for p in batches:
            if not p.num_rows:
                continue
            docs, tf, size = (np.frombuffer(b"".join(p.column(c).to_pylist()), t) for c, t in (("docs", np.int16), ("tfs", np.int32), ("sizes", np.int32)))
            part = tf / (tf + k1 * (1 - b + b * size / avgdl))
            ends = np.concatenate([[0], np.cumsum(p.column("df").to_numpy())])
            row = np.repeat(np.arange(p.num_rows), np.diff(ends))
            first = np.flatnonzero(np.diff(row * RANGE + docs // BLOCK, prepend=-1))
            high = np.maximum.reduceat(part, first)
            at = np.searchsorted(row[first], np.arange(p.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [p.column("range"), p.column("term"), p.column("df"), pa.array(np.maximum.reduceat(part, ends[:-1])), p.column("docs"), _cut(part, ends), _cut((docs[first] // BLOCK).astype(np.int16), at), _cut(high, at)], _names(_ROWS)
            )

    return run


def build(docs: DataFrame, path: str | None = None, *, k1: float = 1.5, b: float = 0.75) -> TextIndex:
    """Index docs (node_id, text). Null texts are documents without terms; rows without an id are left out."""
    spark = docs.sparkSession
    root = path or work.shared_dir(spark)
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a few files of one row group each: cutting texts takes longer than moving them
        docs = docs.select("node_id", "text").repartition(cores)
    cut = docs.where("node_id IS NOT NULL").select(F.col("node_id").cast("long").alias("node_id"), tokens(F.col("text")).alias("terms"))
    packs = work.stored(cut.mapInArrow(_pack, _PACKS), f"{root}/packs")
    whole, rest = packs.where("term = ''"), packs.where("term <> ''")
    n, size, ranges = whole.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rest.mapInArrow(_weigh(size / max(n, 1), k1, b), _ROWS)
    name = f"text_index_{uuid.uuid4().hex}"
    rows.repartition(buckets, "term").write.bucketBy(buckets, "term").sortBy("term", "range").option("path", f"{root}/postings").saveAsTable(name)
    postings = spark.table(name)
    terms = work.stored(postings.groupBy("term").agg(F.sum("df").alias("df")), f"{root}/terms")
    ids = work.stored(whole.select("range", F.col("docs").alias("ids")), f"{root}/ids")
    work.forget(spark, f"{root}/packs")
    return TextIndex(postings, ids, terms, n, size / max(n, 1), ranges)


def asked_terms(index: TextIndex, queries: DataFrame) -> tuple[DataFrame, bool]:
    """(query_id, term, weight): each query's distinct terms that a document has; and whether they may be broadcast."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    weight = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # A term takes its own bytes and 24 for query and weight; with what parts it from the next it has three letters at least.
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return q.distinct().join(index.terms, "term").select("query_id", "term", weight.alias("weight")), 9 * size <= BROADCAST


def bounds(index: TextIndex, asked: DataFrame, small: bool) -> DataFrame:
    """(query_id, range, bound): the most that a document of the range can score. Reads three columns of the index."""
    met = index.postings.select("term", "range", "high").join(F.broadcast(asked) if small else asked, "term")
    return met.groupBy("query_id", "range").agg(F.sum(F.col("weight") * F.col("high")).alias("bound"))


def _best_of_range(terms: list, ids: np.ndarray, bound: np.ndarray, floors: dict, q: int, least: float, k: int | None, count: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A range's k best documents of a query: the most promising blocks first, then those that still reach the floor.

    terms: weight, documents, contributions, blocks, highs of each. floors: a task's k best scores of each query so far.
    """
    total, score = int((bound > 0).sum()), np.zeros(len(ids))
    order = np.argsort(-bound, kind="stable")[:total]
    steps = [order] if k is None else [order[: 2 + k // BLOCK], order[2 + k // BLOCK :]]
    for step in steps:
        best = floors.get(q, np.zeros(0))
        floor = max(least, best[0] if k is not None and len(best) >= k else 0.0)
        open_ = np.zeros(len(bound), bool)
        open_[step[bound[step] >= floor - SLACK]] = True
        count[0] += int(open_.sum())
        count[1] += len(step) - int(open_.sum())
        if open_.any():
            fresh = np.zeros(len(ids))
            for weight, docs, parts, _, _ in terms:
                inside = open_[docs // BLOCK]
                fresh[docs[inside]] += weight * parts[inside]
            score += fresh
            if k is not None:
                value = np.round(fresh[fresh > 0], ranking.PLACES)
                floors[q] = np.sort(np.concatenate([best, value]))[-k:]
    hit = np.flatnonzero(score > 0)
    value = np.round(score[hit], ranking.PLACES)
    top = ranking._best(value, ids[hit], k)
    return ids[hit][top], value[top]


def _score(k: int | None):
    """The k best of each query over a task's ranges, with counts of blocks scored and skipped in a last row."""

    def run(batches):
        kept, floors, key, rows, count = ranking._Kept(k), {}, None, [], [0, 0]

        def meet():
            ids, asked, least = None, {}, {}
            for term, docs, parts, blocks, highs, askers in rows:
                if not term:
                    ids = np.frombuffer(docs, "<i8")
                    continue
                row = np.frombuffer(docs, np.int16), np.frombuffer(parts, np.float64), np.frombuffer(blocks, np.int16), np.frombuffer(highs, np.float64)
                for x in askers:
                    asked.setdefault(x["query_id"], []).append((x["weight"], *row))
                    least[x["query_id"]] = x["least"]
            for q, terms in asked.items():
                bound = np.zeros(-(-len(ids) // BLOCK))
                for weight, _, _, blocks, highs in terms:
                    bound[blocks] += weight * highs
                hits = _best_of_range(terms, ids, bound, floors, q, least[q], k, count)
                yield from kept.add(np.full(len(hits[0]), q), *hits)

        def told(hits: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*hits.columns, pa.nulls(hits.num_rows, pa.int64()), pa.nulls(hits.num_rows, pa.int64())], _names(_FOUND))

        for p in batches:
            for r, *row in zip(*(p.column(c).to_pylist() for c in ("range", "term", "docs", "parts", "blocks", "highs", "askers")), strict=True):
                if r != key:
                    yield from map(told, meet())
                    key, rows = r, []
                rows.append(row)
        yield from map(told, meet())
        if kept.rows:
            yield told(kept.out())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array(count[:1], pa.int64()), pa.array(count[1:], pa.int64())], _names(_FOUND))

    return run


def _askers(*keys: str):
    return lambda df: df.groupBy(*keys).agg(F.collect_list(F.struct("query_id", "weight", "least")).alias("askers"))


def _meet(met: DataFrame, ids: DataFrame, k: int | None) -> DataFrame:
    met = met.select("range", "term", "docs", "parts", "blocks", "highs", "askers")
    none, empty = F.lit(None).cast("binary"), F.array().cast(met.schema["askers"].dataType)
    ids = ids.select("range", F.lit("").alias("term"), F.col("ids").alias("docs"), none.alias("parts"), none.alias("blocks"), none.alias("highs"), empty.alias("askers"))
    return met.unionByName(ids).repartition("range").sortWithinPartitions("range").mapInArrow(_score(k), _FOUND)


def score_all(index: TextIndex, asked: DataFrame, k: int | None, small: bool) -> DataFrame:
    """Score every range that has a query's term, in one round."""
    wanted = asked.withColumn("least", F.lit(0.0)).transform(_askers("term"))
    return _meet(index.postings.join(F.broadcast(wanted) if small else wanted, "term"), index.ids, k)


def score_pairs(index: TextIndex, asked: DataFrame, pairs: DataFrame, k: int, small: bool) -> DataFrame:
    """Score the pairs (query_id, range, least): (query_id, node_id, score), and rows without a query that count blocks."""
    wanted = pairs.join(F.broadcast(asked) if small else asked, "query_id").transform(_askers("range", "term"))
    return _meet(index.postings.join(wanted, ["term", "range"]), index.ids.join(pairs.select("range").distinct(), "range", "left_semi"), k)


def search(index: TextIndex, queries: DataFrame, k: int | None) -> DataFrame:
    """BM25 of the index for queries (query_id, text), each distinct query term once: the k best of each, ties by id."""
    return ranking.ranked(found(index, queries, k).where("query_id IS NOT NULL").select("query_id", "node_id", "score"), k)


def found(index: TextIndex, queries: DataFrame, k: int | None) -> DataFrame:
    """What is scored, with counts of blocks: in one round where the ranges are few for the cores at hand, else in two."""
    asked, small = asked_terms(index, queries)
    if k is None or index.ranges <= ONE_ROUND * queries.sparkSession.sparkContext.defaultParallelism:
        return score_all(index, asked, k, small)
    root = work.shared_dir(queries.sparkSession)
    every = work.stored(bounds(index, asked, small), f"{root}/bounds")
    first = every.groupBy("query_id").agg(F.max_by("range", F.struct("bound", "range")).alias("range"))
    one = work.stored(score_pairs(index, asked, first.withColumn("least", F.lit(0.0)), k, small), f"{root}/first")
    floor = ranking.ranked(one.where("query_id IS NOT NULL").select("query_id", "node_id", "score"), k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("least"))
    rest = every.join(first, ["query_id", "range"], "left_anti").join(floor, "query_id").where(F.col("bound") >= F.col("least") - SLACK)
    return one.unionByName(score_pairs(index, asked, rest.select("query_id", "range", "least"), k, small))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Index docs and search them once."""
    return search(build(docs, k1=k1, b=b), queries, k)


_INDEXES: dict[tuple, TextIndex] = {}


def state(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a Parquet table from another in this session: its files with their sizes and times."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return spark.sparkContext.applicationId, path, *files.agg(F.bit_xor(F.xxhash64("*")), F.count(F.lit(1))).first()


def of_table(spark: SparkSession, path: str, docs: DataFrame) -> TextIndex:
    """The index of docs, which come from the Parquet table at `path`; built once a session for each state of the table's files."""
    key = state(spark, path)
    if key not in _INDEXES:
        _INDEXES[key] = build(docs)
    return _INDEXES[key]

"""Ranked lexical search over a bit-sliced impact index.

Documents are numbered inside blocks of about BLOCK_BYTES of text. For each block and term the index holds bitmaps, one for
each bit of the term's impact on the block's documents: slice b has the documents whose impact has bit b. Only words of 64
documents that hold the term are kept. A search adds the bitmaps of a query's terms by bitwise carries (sum and carry are
kept apart until all terms are in) and walks the slices of the sum from the most significant one down: what has the bit
stays in front, until k documents are told apart. Each task keeps its k best of each query; only these are shuffled.

Terms are maximal runs of ASCII letters, digits and all characters outside ASCII; A-Z is lower-cased. All arithmetic of
impacts is in 64-bit integers but for a term's weight, floor(1000 ln((2N+2)/(2df+1))). A document's impact for a term
that it has tf times is weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L for its n terms, the N documents with
terms and all their L terms.

Defined results: a null or empty text has no terms and is never found; repeated documents are found each; a document
without id counts in the statistics and comes after those of equal score; queries of one id are one query with the terms of
all; a query without id takes no part; other columns are not read; an empty table or no query gives an empty result.
Blocks hold whole texts, so a very long text is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces_of, shared_dir, split_words, stored, table, tidy

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 1 << 16
#: Queries that meet a block's index at once.
QUERIES = 256
#: The most bytes of query texts whose terms are broadcast; more are joined by shuffle.
BROADCAST = 8 << 20
#: What each byte becomes: a blank outside terms, a small letter for a capital one.
_FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_FOLD[65:91] += 32

_POSTINGS = "block long, term string, df long, size long, docs binary, tfs binary, sizes binary"
_SLICES = "block long, term string, bits int, words binary, slices binary"


def query_terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0))


def cut_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and where each text's terms start."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer((off - off[0]).tobytes()), pa.py_buffer(_FOLD[data].tobytes()))
    return split_words(folded, False)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between successive cuts, as one binary value each."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _post(block_bytes: int):
    """Blocks of documents as postings: a row for each term, and under the empty term the ids with the block's totals."""

    @tidy
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for part in pieces_of(batches, 1, block_bytes, BLOCK_ROWS):
            flat, off = cut_terms(part.column(1))
            n = np.diff(off).astype(np.int32)
            coded = flat.dictionary_encode()
            pair = coded.indices.to_numpy().astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
            pair, tf = np.unique(pair, return_counts=True)
            term, doc = pair // max(len(n), 1), (pair % max(len(n), 1)).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
            ids = part.column(0)
            head = [pa.array([block]), pa.array([""]), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                    pa.array([pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()), pa.array([b""], pa.binary())]
            names = [f.split()[0] for f in _POSTINGS.split(", ")]
            yield pa.RecordBatch.from_arrays(head, names)
            if len(term):
                rows = len(cuts) - 1
                same = [pa.array(np.full(rows, block)), coded.dictionary, pa.array(np.diff(cuts)), pa.array(np.zeros(rows, np.int64))]
                yield pa.RecordBatch.from_arrays([*same, _packed(doc, cuts), _packed(tf.astype(np.int32), cuts), _packed(n[doc], cuts)], names)
            block += 1

    return run


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What terms add to the scores of documents: tf occurrences among n terms; docs and terms are the totals N and L."""
    m = 50 + (50 * n.astype(np.int64) * docs) // terms
    tf = tf.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


@tidy
def _slice(batches):
    """Postings with weights as bit slices."""
    for b in batches:
        if not b.num_rows:
            continue
        docs, tf, n = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32) for c in ("docs", "tfs", "sizes"))
        size = b.column("df").to_numpy()
        row = np.repeat(np.arange(b.num_rows), size)
        total = b.column("n_docs")[0].as_py(), b.column("n_terms")[0].as_py()
        impact = impacts(tf, n, b.column("weight").to_numpy()[row], *total)
        key = row * (1 << 32) + (docs >> 6)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        word, owner = (docs >> 6)[first].astype(np.int32), row[first]
        cuts = np.searchsorted(owner, np.arange(b.num_rows + 1))
        high = np.maximum.reduceat(impact, np.concatenate([[0], np.cumsum(size)[:-1]]))
        bits = np.array([int(x).bit_length() for x in high], np.int32)
        place = (docs & 63).astype(np.uint64)
        # Documents of a word have bits of their own, so their sum is their union.
        planes = [np.add.reduceat(((impact >> k) & 1).astype(np.uint64) << place, first) for k in range(int(bits.max()))]
        planes = np.stack(planes) if planes else np.zeros((0, len(first)), np.uint64)
        slices = [planes[: bits[i], cuts[i] : cuts[i + 1]].tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("term"), pa.array(bits), _packed(word, cuts), pa.array(slices, pa.binary())], [f.split()[0] for f in _SLICES.split(", ")])


def build_index(docs: DataFrame, path: str, *, terms: DataFrame | None = None, broadcast: bool = False, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the bit-sliced index of all documents below `path` and return it as stored.

    terms: column term; only these are indexed (all, if not given), every document counts for the statistics all the same.
    broadcast: whether the terms are small enough to be sent to every task.
    """
    low = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = low.mapInArrow(_post(block_bytes), _POSTINGS)
    if terms is not None:
        asked = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        rows = rows.join(F.broadcast(asked) if broadcast else asked, "term", "left_semi").select(*rows.columns)
    post = stored(rows, f"{path}/postings")
    whole = post.where("term = ''")
    totals = whole.agg(F.sum("df").alias("n_docs"), F.sum("size").alias("n_terms"))
    df = post.where("term <> ''").groupBy("term").agg(F.sum("df").alias("held"))
    ratio = (2 * F.col("n_docs") + 2).cast("double") / (2 * F.col("held") + 1)
    weights = df.crossJoin(F.broadcast(totals)).select("term", "n_docs", "n_terms", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"))  # one row of totals
    made = post.where("term <> ''").join(weights, "term").mapInArrow(_slice, _SLICES)
    ids = whole.select("block", "term", F.lit(0).alias("bits"), F.col("docs").alias("words"), F.col("tfs").alias("slices"))
    return stored(made.unionByName(ids), f"{path}/slices")


def add_slices(planes: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """The sum of numbers given as bit slices: (words, slices of these words) each. Sum and carry stay apart until all are in;
    one ripple of carries ends it. Returns slices of all `width` words, the least significant first."""
    high = max((len(x) for _, x in planes), default=0) + len(planes).bit_length()
    s, c = np.zeros((high, width), np.uint64), np.zeros((high, width), np.uint64)
    for words, x in planes:
        k = len(x)
        # The first k slices take the new number; above them sum and carry stay as they are, with the last carry put in.
        a, b = s[:k, words], c[:k, words]
        half = a ^ b
        s[:k, words] = half ^ x
        up = (a & b) | (half & x)
        c[0, words] = 0
        c[1:k, words] = up[:-1]
        over = up[-1] if k else None
        while over is not None and over.any():  # the carry out of slice k meets what stands there
            a, b = s[k, words], c[k, words]
            half = a ^ b
            s[k, words], c[k, words] = half ^ over, 0
            over, k = (a & b) | (half & over), k + 1
    carry = np.zeros(width, np.uint64)
    for i in range(high):
        half = s[i] ^ c[i]
        s[i], carry = half ^ carry, (s[i] & c[i]) | (half & carry)
    return s


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_places(planes: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k highest numbers above 0 given as slices; equal ones by their `order`."""
    left = np.bitwise_or.reduce(planes, axis=0) if len(planes) else np.zeros(0, np.uint64)
    sure, need = np.zeros_like(left), k
    for x in planes[::-1]:
        with_bit = left & x
        n = int(np.bitwise_count(with_bit).sum())
        if n > need:
            left = with_bit
        else:
            sure, need, left = sure | with_bit, need - n, left & ~x
            if not need:
                break
    ties = _places(left) if need else np.zeros(0, np.int64)
    places = np.concatenate([_places(sure), ties[np.argsort(order[ties], kind="stable")[:need]]])
    value = np.zeros(len(places), np.int64)
    for b, x in enumerate(planes):
        value |= ((x[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
    return places, value


class _Best:
    """A task's k best documents of each query."""

    def __init__(self, k: int):
        self.k, self.rows, self.n = k, [], 0

    def add(self, *row: np.ndarray) -> None:
        self.rows.append(row)
        self.n += len(row[0])
        if self.n > 1_000_000:
            self.cut()

    def cut(self) -> None:
        q, d, gone, score = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((d, gone, -score, q))
        q = q[order]
        first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, int)
        turn = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = order[turn < self.k]
        q, d, gone, score = (np.concatenate(x)[keep] for x in zip(*self.rows, strict=True))
        self.rows, self.n = [(q, d, gone, score)], len(q)


def _find(k: int):
    """The index's rows of a block and a group of queries come together; each query's sum gives the block's k best."""

    @tidy
    def run(batches):
        best, key, rows = _Best(k), None, []

        def meet():
            ids = gone = None
            asked: dict[int, list] = {}
            for term, words, slices, bits, askers in rows:
                if not term:
                    ids, gone = np.frombuffer(words, "<i8"), np.frombuffer(slices, np.uint8).astype(bool)
                elif bits:
                    w = np.frombuffer(words, np.int32)
                    plane = w, np.frombuffer(slices, np.uint64).reshape(bits, len(w))
                    for q in askers:
                        asked.setdefault(q, []).append(plane)
            if not asked:
                return
            order = np.empty(len(ids), np.int64)
            order[np.lexsort((ids, gone))] = np.arange(len(ids))
            width = -(-len(ids) // 64)
            for q, planes in asked.items():
                places, score = top_places(add_slices(planes, width), order, k)
                best.add(np.full(len(places), q), ids[places], gone[places], score)

        for b in batches:
            for block, group, *row in zip(*(b.column(c).to_pylist() for c in ("block", "part", "term", "words", "slices", "bits", "askers")), strict=True):
                if (block, group) != key:
                    meet()
                    key, rows = (block, group), []
                rows.append(row)
        meet()
        if best.rows:
            best.cut()
            q, d, gone, score = best.rows[0]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64(), mask=gone), pa.array(score, pa.int64())], ["query_id", "doc_id", "score"])

    return run


def search(index: DataFrame, questions: DataFrame, k: int, *, broadcast: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (query_id, term), with a score above 0."""
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), "term").where("query_id IS NOT NULL").distinct()
    many = -(-asked.select("query_id").distinct().count() // QUERIES)
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(many, 1))).cast("int")
    by_term = asked.withColumn("part", group).groupBy("part", "term").agg(F.collect_list("query_id").alias("askers"))
    # Ids of a block go to every group of queries.
    everywhere = questions.sparkSession.range(many).select(F.col("id").cast("int").alias("part"), F.lit("").alias("term"), F.array().cast("array<bigint>").alias("askers"))
    by_term = by_term.unionByName(everywhere)
    met = index.join(F.broadcast(by_term) if broadcast else by_term, "term")
    hits = met.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_find(k), "query_id long, doc_id long, score long")
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.select("query_id", F.row_number().over(turn).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50, *, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best of docs (doc_id, text) for each of queries (query_id, text); the index of the queries' terms is built on the way."""
    root = path or shared_dir(docs.sparkSession)
    questions = stored(queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term")), f"{root}/questions")
    # A term goes with its id and its part of a list: 32 bytes besides its letters.
    size = questions.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    small = size <= BROADCAST
    index = build_index(docs, root, terms=questions, broadcast=small, block_bytes=block_bytes)
    return search(index, questions, k, broadcast=small)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rank_documents(table(spark, sf_dir, "documents"), items).withColumnRenamed("query_id", "item_id")


_CUT = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE = rf"""WITH cut AS (SELECT row_number() OVER () AS row, doc_id, {_CUT} AS terms FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM cut),
asked AS (SELECT DISTINCT item_id, unnest({_CUT}) AS term FROM benchmark WHERE item_id IS NOT NULL),
post AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM cut) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY term),
hit AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM post JOIN asked USING (term) JOIN weight USING (term), total GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM hit WHERE score > 0 QUALIFY rank <= 50"""

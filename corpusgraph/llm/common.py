"""Shared helpers of the training-data operators: word hashing, work folders, doc splits.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; lower-casing touches A-Z only, so both
rules act on UTF-8 bytes and never split or alter a multi-byte character.
"""

from __future__ import annotations

import ctypes
import re
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: An odd multiplier; powers of it weigh the words of a window.
BASE = U64(0x9E3779B97F4A7C15)
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Only on one machine, as in tests, is a folder chosen here where that setting is missing; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/corpusgraph-checkpoints")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/corpusgraph-{uuid.uuid4().hex}"


#: Has Spark remove a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut of lineage that survives lost executors.

    The shuffles behind it go when it is written; what they cost on disk does not add up over steps.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def key_mod(col: str | Column, m: int = 5) -> Column:
    """crc32 of the key's decimal text, modulo m; a null key counts as empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(m))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_of(batches, text: int, limit: int = SLICE_BYTES, rows: int = 4096):
    """Cut record batches into slices of about `limit` bytes of text (or items of lists) and at most `rows` rows; a row
    is never cut."""
    for batch in batches:
        col = batch.column(text)
        length = pc.list_value_length if pa.types.is_list(col.type) else pc.binary_length
        size = pc.fill_null(length(col), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = sorted({0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *range(rows, batch.num_rows, rows), batch.num_rows})
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words start (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, off = lists.flatten(), lists.offsets.to_numpy()
    off = off - off[0]
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), before[off]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, U64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    uniq = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), U64, len(coded.dictionary))
    return uniq[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def window_hashes(h: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of h[i:i+k] for every i with a whole window, by differences of weighted prefix sums modulo 2**64."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    inverse = U64(pow(int(base), -1, 1 << 64))
    down = np.full(n, inverse)
    down[0] = 1
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, U64)
    np.cumsum(h * down, out=sums[1:])
    up = np.full(n - k + 1, base)
    up[0] = 1
    np.cumprod(up, out=up)
    return mix((sums[k:] - sums[:-k]) * up)


def whole_windows(off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of k words that lie in one text, and the text of each."""
    n = np.maximum(np.diff(off) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
    return np.arange(len(doc)) - np.repeat(first, n) + np.repeat(off[:-1], n), doc


def give_back() -> None:
    """Give the worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def tidy(run):
    """The same batch function; at its end the worker, which serves later tasks too, gives free memory back."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def steady_heap() -> None:
    """Keep arrays of up to 4 MB on the worker's heap: mapping and unmapping them anew costs more than small steps of numpy.
    Larger ones are mapped, so they are given back as soon as they are free."""
    if sys.platform == "linux":
        mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
        if mallopt is not None:
            mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_corpusgraph_worker", types.ModuleType("_corpusgraph_worker")).__dict__


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents whose key is not held out (crc32 mod 5 is not 0).

    The labels are drawn by hash of the id, so the bound holds before texts are read and the draw is the same at any
    partitioning; the drawn ids, `rows` at most, are broadcast.
    """
    drawn = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (key_mod("doc_id") != 0))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")

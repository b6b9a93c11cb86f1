"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of `block` words, and every rolling window of `block`
words probes them. A repeat of at least 2*block - 1 words contains a whole block of either side, so with
block = 25 no repeat of 50 words escapes. Probes that meet a block of another place are anchors. Each anchor is
extended: the windows of `window` words around it are compared by content over all documents, and a window counts
as repeated where the same words start in a document with a smaller id. Repeated windows that overlap or touch form
maximal repeats, whose words go. Content is compared by 96-bit fingerprints of the word sequence.

Probes travel packed: for each slice of documents and each partition of the hash space one row holds 40-bit hashes and
word positions as byte gaps, about 7 bytes a word. A partition holds a fixed share of the hash space. What repeats
inside a slice is settled there: of equal probes the first goes to the hash space and all are anchors, of equal windows only those of
the slice's smallest id go and all others are repeats. What is settled travels dealt by document, so a passage in every
document adds a probe for each slice to its partition, not one for each document, and pairs of occurrences are never formed.

Defined results: null and empty texts have no words; documents shorter than the window lose nothing; a repeat
inside one document, or between rows with one id, is no repeat; rows that share an id each lose their own repeats; equal texts keep their words only under the
smallest id; a null id has no order and neither loses nor causes a loss; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, mix, pieces_of, shared_dir, shuffle_partitions, split_words, stored, table, tidy, whole_windows, window_hashes, word_hashes

WINDOW, BLOCK = 50, 25
#: Weighs words for the second fingerprint.
OTHER = U64(0xC2B2AE3D27D4EB4F)
#: So many bytes of text for each partition of the hash space at most, and for each partition of the documents.
PART_BYTES = 64 << 20
#: Probes that are looked up at once.
SOME = 1 << 20
PACKED = "part int, docs binary, counts binary, gaps binary, wide binary, hashes binary, marks binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_TYPES = [pa.int32()] + [pa.binary()] * 6


def _gaps(pos: np.ndarray, first: np.ndarray) -> tuple[bytes, bytes]:
    """Positions as gaps from the one before in the same document: a byte each, 255 stands for a wide gap kept apart."""
    gap = np.diff(pos, prepend=0)
    gap[first] = pos[first]
    large = gap >= 255
    return np.where(large, 255, gap).astype(np.uint8).tobytes(), gap[large].astype("<u4").tobytes()


def _positions(gaps: bytes, wide: bytes, counts: np.ndarray) -> np.ndarray:
    gap = np.frombuffer(gaps, np.uint8).astype(np.int64)
    gap[gap == 255] = np.frombuffer(wide, "<u4")
    total = np.cumsum(gap)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    before = np.concatenate([[0], total])[start]
    return total - np.repeat(before, counts)


def _pack(parts: int, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, part: np.ndarray, hashes: np.ndarray | None = None, marks: np.ndarray | None = None):
    """One row for each partition. keys: ids and rows by index; hashes: an array of bytes a row, none for what is settled."""
    order = np.argsort(part, kind="stable") if parts > 1 else np.arange(len(part))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    cols = [[] for _ in _NAMES]
    for p in range(parts):
        i = order[bounds[p] : bounds[p + 1]]
        if not len(i):
            continue
        first = np.flatnonzero(np.diff(doc[i], prepend=-1))
        gaps, wide = _gaps(pos[i], first)
        counts = np.diff(np.append(first, len(i))).astype("<u4")
        row = p, keys[doc[i[first]]].astype("<i8").tobytes(), counts.tobytes(), gaps, wide, b"" if hashes is None else hashes[i].tobytes(), b"" if marks is None else np.packbits(marks[i]).tobytes()
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _share(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of the hash space that a hash lies in."""
    return ((h >> U64(40)) % U64(parts)).astype(np.int64)


def _deal(rows: np.ndarray, parts: int) -> np.ndarray:
    """The partition that a document's row is dealt to."""
    return (mix(rows.astype(U64)) % U64(parts)).astype(np.int64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal entries, the first key deciding first: their order, where each group starts in it, and the group of each entry in order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _low(h: np.ndarray, n: int) -> np.ndarray:
    """The low n bytes of each hash, as rows of bytes."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _probes(parts: int, window: int, block: int):
    def run(batches):
        for b in pieces_of(batches, 2):
            words, off = split_words(b.column(2), lower=False)
            # Shorter documents have no window, hence no repeat.
            long = np.flatnonzero(np.diff(off) >= window)
            if not len(long):
                continue
            h = window_hashes(word_hashes(words), block)
            pos, doc = whole_windows(off, block)
            inside = np.isin(doc, long)
            pos, doc = pos[inside], doc[inside]
            h, at, keys = h[pos], pos - off[:-1][doc], _keys(b)
            order, start, group = _groups(h)
            marks = np.zeros(len(h), bool)
            marks[order[start]] = np.logical_or.reduceat((at % block == 0)[order], start)
            first = np.zeros(len(h), bool)
            first[order[start]] = True
            again = np.zeros(len(h), bool)
            again[order] = (np.bincount(group) > 1)[group]
            yield _pack(parts, keys, doc[first], at[first], _share(h[first], parts), _low(h[first], 5), marks[first])
            if again.any():
                yield _pack(parts, keys, doc[again], at[again], _deal(keys[doc[again], 1], parts))

    return run


def _keys(b: pa.RecordBatch) -> np.ndarray:
    """Each document's id and row: rows that share an id are told apart by a hash of both id and text."""
    return np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)


def _unpack_all(rows: list[tuple], width: int):
    """Documents (id and row), each probe's document by its number, positions, hashes as bytes (of no width for what is settled)
    and marks of packed rows."""
    keys, of, pos, hashes, marks, n = [], [], [], [], [], 0
    for docs, counts, gaps, wide, h, m in rows:
        c = np.frombuffer(counts, "<u4").astype(np.int64)
        keys.append(np.frombuffer(docs, "<i8").reshape(-1, 2))
        of.append(np.repeat(np.arange(n, n + len(c), dtype=np.int32), c))
        n += len(c)
        pos.append(_positions(gaps, wide, c).astype(np.uint32))
        hashes.append(np.frombuffer(h, np.uint8).reshape(len(pos[-1]), width))
        if m:
            marks.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(pos[-1])).astype(bool))
    return np.concatenate(keys), np.concatenate(of), np.concatenate(pos), np.concatenate(hashes), np.concatenate(marks) if marks else None


def _by_part(batches):
    """The packed rows of each partition of the hash space in turn; they come sorted by it."""
    part, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for p, *rest in zip(*cols, strict=True):
            if p != part and rows:
                yield rows
                rows = []
            part = p
            rows.append(tuple(rest))
    if rows:
        yield rows


def _settled(rows: list[tuple], parts: int):
    """The places that a slice has settled, and the packed rows that it has not."""
    known = [r for r in rows if not r[4]]
    out = []
    if known:
        keys, of, pos, *_ = _unpack_all(known, 0)
        out = list(_marked(parts, keys[of], pos))
    return out, [r for r in rows if r[4]]


def _number(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8")[:, 0]


MARKED = "to int, docs binary, counts binary, runs binary"


def _marked(parts: int, ids: np.ndarray, pos: np.ndarray):
    """Places to tell documents of, packed as runs (first place, length): one row for each partition of the documents."""
    to = _deal(ids[:, 1], parts)
    order = np.lexsort((pos, ids[:, 0], ids[:, 1], to))
    to, ids, pos = to[order], ids[order], pos[order]
    other = np.ones(len(pos), bool)
    other[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    step = np.diff(pos.astype(np.int64), prepend=0)
    keep = other | (step != 0)  # a place is told once
    to, ids, pos, other, step = to[keep], ids[keep], pos[keep], other[keep], step[keep]
    start = np.flatnonzero(other | (step != 1))
    runs = np.stack([pos[start].astype("<u4"), np.diff(np.append(start, len(pos))).astype("<u4")], axis=1)
    to, ids, other = to[start], ids[start], other[start]
    bounds = np.searchsorted(to, np.arange(parts + 1))
    rows = []
    for p in range(parts):
        a, z = bounds[p], bounds[p + 1]
        if a < z:
            first = np.flatnonzero(other[a:z])
            counts = np.diff(np.append(first, z - a)).astype("<u4")
            rows.append((p, ids[a:z][first].astype("<i8").tobytes(), counts.tobytes(), runs[a:z].tobytes()))
    if rows:
        kinds = pa.int32(), pa.binary(), pa.binary(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["to", "docs", "counts", "runs"])


def _gather(batches):
    """One row for each document: all its runs of places."""
    for rows in _by_part(batches):
        n = [np.frombuffer(r[1], "<u4") for r in rows]
        ids = np.concatenate([np.repeat(np.frombuffer(r[0], "<i8").reshape(-1, 2), c, axis=0) for r, c in zip(rows, n, strict=True)])
        runs = np.concatenate([np.frombuffer(r[2], "<u4").reshape(-1, 2) for r in rows])
        order = np.lexsort((runs[:, 0], ids[:, 0], ids[:, 1]))
        ids, runs = ids[order], runs[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
        bounds = np.append(first, len(ids))
        for a in range(0, len(first), 2000):
            z = min(a + 2000, len(first))
            told = [runs[bounds[i] : bounds[i + 1]].tobytes() for i in range(a, z)]
            key = ids[first[a:z]]
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(told, pa.binary())], ["doc_id", "row", "runs"])


def _ends(runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of each run."""
    r = np.frombuffer(runs, "<u4").astype(np.int64).reshape(-1, 2)
    return r[:, 0], r[:, 0] + r[:, 1] - 1


def _anchors(parts: int):
    """Probes whose words are a block somewhere and occur at another place as well, and those settled."""

    def run(batches):
        for rows in _by_part(batches):
            known, rows = _settled(rows, parts)
            yield from known
            if not rows:
                continue
            keys, of, pos, raw, marks = _unpack_all(rows, 5)
            h = _number(raw)
            blocks = np.unique(h[marks])
            if not len(blocks):
                continue
            hits, place = [], []
            for a in range(0, len(h), SOME):  # a few probes at a time beside the arrays of all
                at = np.minimum(np.searchsorted(blocks, h[a : a + SOME]), len(blocks) - 1)
                met = np.flatnonzero(blocks[at] == h[a : a + SOME])
                hits.append(met + a)
                place.append(at[met])
            hits, place = np.concatenate(hits), np.concatenate(place)
            hits = hits[(np.bincount(place, minlength=len(blocks)) > 1)[place]]
            yield from _marked(parts, keys[of[hits]], pos[hits])

    return run


def _around(parts: int, window: int, block: int):
    """Windows around the anchors, with fingerprints of their words."""

    def run(batches):
        for b in pieces_of(batches, 2):
            words, off = split_words(b.column(2), lower=False)
            near = np.zeros(len(words) + 1, np.int32)
            for i, marks in enumerate(b.column(3).to_pylist()):
                for runs in marks:
                    head, tail = _ends(runs)
                    last = np.minimum(tail, off[i + 1] - off[i] - window)
                    start = np.maximum(head - (window - block), 0)
                    ok = last >= start
                    np.add.at(near, off[i] + start[ok], 1)
                    np.add.at(near, off[i] + last[ok] + 1, -1)
            starts, doc = whole_windows(off, window)
            inside = np.cumsum(near)[starts] > 0
            starts, doc = starts[inside], doc[inside]
            if not len(starts):
                continue
            w = word_hashes(words)
            one, two = window_hashes(w, window)[starts], window_hashes(w, window, OTHER)[starts]
            raw = np.concatenate([_low(one, 8), _low(two, 4)], axis=1)
            keys, at = _keys(b), starts - off[:-1][doc]
            order, start, group = _groups(one, two & U64(0xFFFFFFFF))
            ids = keys[doc, 0]
            late = np.zeros(len(one), bool)
            late[order] = ids[order] > np.minimum.reduceat(ids[order], start)[group]
            yield _pack(parts, keys, doc[~late], at[~late], _share(one[~late], parts), raw[~late])
            if late.any():
                yield _pack(parts, keys, doc[late], at[late], _deal(keys[doc[late], 1], parts))

    return run


def _later(parts: int):
    """Windows whose words also start in a document with a smaller id, and those settled."""

    def run(batches):
        for rows in _by_part(batches):
            known, rows = _settled(rows, parts)
            yield from known
            if not rows:
                continue
            keys, of, pos, raw, _ = _unpack_all(rows, 12)
            a, b = _number(raw[:, :8]), _number(raw[:, 8:])
            ids = keys[of, 0]
            order = np.lexsort((ids, b, a))
            a, b, ids, of, pos = a[order], b[order], ids[order], of[order], pos[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            late = ids > least
            yield from _marked(parts, keys[of[late]], pos[late])

    return run


def _cut(window: int):
    names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string()]

    def run(batches):
        for b in pieces_of(batches, 2):
            rows, more = [], b.schema.names[3:-1]
            for key, text, marks in zip(*(b.column(i).to_pylist() for i in (0, 2, -1)), strict=True):
                words = (text or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int32)
                for runs in marks or ():
                    head, tail = _ends(runs)
                    tail = np.minimum(tail, len(words) - window)
                    head, tail = head[head <= tail], tail[head <= tail]
                    np.add.at(cover, head, 1)
                    np.add.at(cover, tail + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                if spans:
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((key, len(gone), int(gone.sum()), spans, b" ".join(words).decode()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(c) for c in more)], [*names, *more])

    return run


def _spread(packed: DataFrame, parts: int, by: str = "part") -> DataFrame:
    return packed.repartition(parts, by).sortWithinPartitions(by)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
                   carry: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans (maximal repeats removed: start and length in words), kept
    (the words left, joined by one space), then the carried columns as in_<name>. As many rows as came in.

    The places of anchors are stored below `path` (by default a new folder below spark.checkpoint.dir), for as long as the result is read.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must contain a whole block wherever it starts")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(text_col).alias("text"), *(F.col(c).alias(f"in_{c}") for c in carry))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))
    # Both joins see one and the same plan of dealt texts, so the exchange runs once; rows without an id have no part in it.
    known, key = rows.where("doc_id IS NOT NULL"), ["doc_id", "row"]
    dealt = known.repartition(parts, *key)
    marks = lambda df: _spread(df, parts, "to").mapInArrow(tidy(_gather), "doc_id long, row long, runs binary").select(*key, F.array("runs").alias("marks"))
    found = _spread(known.select(*key, "text").mapInArrow(tidy(_probes(parts, window, block)), PACKED), parts).mapInArrow(tidy(_anchors(parts)), MARKED)
    # The anchors' places are few beside the probes, whose exchange goes before texts are dealt.
    found = stored(found, f"{path or shared_dir(docs.sparkSession)}/anchors")
    near = dealt.join(marks(found).hint("shuffle_hash"), key).select(*key, "text", "marks")
    windows = near.mapInArrow(tidy(_around(parts, window, block)), PACKED)
    late = _spread(windows, parts).mapInArrow(tidy(_later(parts)), MARKED)
    out = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, spans array<struct<start: long, length: long>>, kept string")
    out = T.StructType([*out.fields, *(f for f in rows.schema.fields if f.name.startswith("in_"))])
    cut = dealt.join(marks(late).hint("shuffle_hash"), key, "left")
    nameless = rows.where("doc_id IS NULL").withColumn("marks", F.lit(None).cast("array<binary>"))
    return cut.mapInArrow(tidy(_cut(window)), out).unionByName(nameless.mapInArrow(tidy(_cut(window)), out))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

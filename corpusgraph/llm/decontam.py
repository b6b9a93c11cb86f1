"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared after A-Z become lower case and white space runs become one space. An item of m
characters may differ from a passage by k = floor(rate * m) edits. By the q-gram lemma such a passage shares at
least m + 1 - q * (k + 1) character q-grams with the item, on diagonals (place in text minus place in item) that
span at most k. Shared q-grams are counted in diagonal bands of 2(k+1) that overlap by half, so some band holds
them all; bands that meet the bound are verified by alignment inside the band's diagonals, and the passage with
fewest edits is reported.

q-grams are looked up for whole slices of text at once: a bit table, then a density test (a passage that meets
its bound has a stretch of 128 characters with many shared q-grams), then the exact table near dense stretches.
Items are read in blocks of at most `block_chars` characters, each broadcast in turn; all rows meet all items, no pair
is skipped and no count is capped.

Defined results: null and empty texts match nothing; items of fewer than q characters after normalising match
nothing; k shrinks for short items so that the bound stays positive; equal items or repeated rows each report;
ids may repeat or be null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, pieces_of, table, tidy

Q, RATE, STRETCH, BITS = 8, 0.08, 128, 22
#: Shared q-grams that are counted at once.
SOME = 1 << 18
SPREAD = U64(0x9E3779B97F4A7C15)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points after normalising, and where each stood."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    out = np.where(space, 32, np.where((cp >= 65) & (cp <= 90), cp + 32, cp))[at].astype(np.uint32)
    if len(out) and out[0] == 32:
        out, at = out[1:], at[1:]
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def grams(cp: np.ndarray) -> np.ndarray:
    """The q-gram at each place as a number, from its eight characters folded to bytes: equal q-grams are equal, others
    nearly always differ."""
    folded = ((cp ^ (cp >> 8) ^ (cp >> 16) * 7) & 255).astype(np.uint8)
    n = len(folded) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    eight = np.ndarray((len(folded) - 7,), "<u8", folded.tobytes(), strides=(1,))
    return eight[:n] * SPREAD


@dataclass
class Items:
    """Normalised items, their edit budgets and bounds, and the table of their q-grams."""

    ids: list
    texts: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    need: int
    reach: int


def index(rows: list[tuple], rate: float = RATE) -> Items | None:
    ids, texts, budget = [], [], []
    for key, text in rows:
        t = normalise(text or "")[0]
        if len(t) >= Q:
            ids.append(key)
            texts.append(t)
            budget.append(min(int(rate * len(t)), (len(t) - Q) // Q))
    if not ids:
        return None
    m, budget = np.array([len(t) for t in texts]), np.array(budget)
    bound = m + 1 - Q * (budget + 1)
    gram = np.concatenate([grams(t) for t in texts])
    item = np.repeat(np.arange(len(ids)), m - Q + 1)
    place = np.concatenate([np.arange(n) for n in m - Q + 1])
    order = np.lexsort((place, item, gram))
    bits = np.zeros(1 << BITS, bool)
    bits[(gram * SPREAD) >> U64(64 - BITS)] = True
    # A passage has at most m + k q-gram places; one of its stretches holds its share of the bound.
    need = int(np.ceil(bound / -(-(m + budget) // STRETCH)).min())
    return Items(ids, texts, budget, bound, gram[order], item[order], place[order], bits, need, int((m + budget).max()))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The passage of the text nearest the item, within diagonals low..high and k edits: (edits, start, end), or None.

    Each row of the band holds, by diagonal, the edits and the start of the best passage that ends there.
    """
    first, last = max(low, 0), min(high + len(item), len(text))
    same = text[first:last].tobytes().find(item.tobytes())
    if same >= 0 and same % 4 == 0:  # no edits at all
        return 0, first + same // 4, first + same // 4 + len(item)
    width = high - low + 1
    far = k + 1
    diag = low + np.arange(width)
    cost = np.where((diag >= 0) & (diag <= len(text)), 0, far).astype(np.int64)
    # Cost and start travel as one number, so that of equal costs the latest start (the shortest passage) wins.
    unit = len(text) + 1
    best = cost * unit + (len(text) - np.clip(diag, 0, len(text)))
    slope = np.arange(width) * unit
    limit = far * unit
    for i in range(1, len(item) + 1):
        j = diag + i
        inside = (j >= 1) & (j <= len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside] - 1] == item[i - 1]
        step = best + np.where(same, 0, unit)
        down = np.append(best[1:], limit + unit) + unit
        now = np.minimum(np.where(inside, step, limit), np.where((j >= 0) & (j <= len(text)), down, limit))
        now = np.minimum.accumulate(now - slope) + slope
        best = np.where((j >= 0) & (j <= len(text)), np.minimum(now, limit), limit)
        if best.min() >= limit:
            return None
    d = int(np.argmin(best))
    edits, rest = divmod(int(best[d]), unit)
    return (edits, len(text) - rest, int(diag[d]) + len(item)) if edits <= k else None


def _cells(items: Items, at: np.ndarray, span: np.ndarray, least: int, wide: int):
    """Shared q-grams by item and half band, SOME at a time: a q-gram that repeats in text and item makes their product."""
    total = np.concatenate([[0], np.cumsum(span[:, 1] - span[:, 0])])
    for a in range(0, int(total[-1]), SOME):
        pair = np.arange(a, min(a + SOME, int(total[-1])))
        own = np.searchsorted(total, pair, side="right") - 1
        place = span[own, 0] + pair - total[own]
        item = items.item[place]
        key = item * wide + (at[own] - items.place[place]) // (items.budget[item] + 1) - least
        low = int(key.min())
        if int(key.max()) - low < 4 * len(key):
            count = np.bincount(key - low)
            some = np.flatnonzero(count)
            yield some + low, count[some]
        else:
            yield np.unique(key, return_counts=True)


def _bands(items: Items, at: np.ndarray, span: np.ndarray):
    """(item, lowest diagonal, highest) of the bands that meet the bound; at: places in the text, span: their ranges in the table."""
    # Cells lie no farther out than their diagonals.
    least = min(int(at.min()) - int(items.place.max()), 0) - 1
    wide = int(at.max()) - least + 1
    cells, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for key, count in _cells(items, at, span, least, wide):
        merged = np.union1d(cells, key)
        total = np.zeros(len(merged), np.int64)
        total[np.searchsorted(merged, cells)] += held
        total[np.searchsorted(merged, key)] += count
        cells, held = merged, total
    # A band is two neighbouring cells.
    band = np.union1d(cells, cells - 1)
    count = np.zeros(len(band), np.int64)
    count[np.searchsorted(band, cells)] += held
    count[np.searchsorted(band, cells - 1)] += held
    for i, c in zip(*divmod(band[count >= items.bound[band // wide]], wide), strict=True):
        i, c = int(i), int(c) + least
        h = int(items.budget[i]) + 1
        yield i, c * h, c * h + 2 * h - 1


def matches(items: Items, text: str) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) of every passage of one text; start and end are places in the text as given."""
    cp, at = normalise(text)
    return _of_text(items, cp, at, *_hits(items, cp, np.array([0, len(cp)])))


def _hits(items: Items, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of shared q-grams near dense stretches, and the range of each in the table. Texts lie end to end."""
    g = grams(cp)
    none = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    if not len(g):
        return none
    hit = items.bits[(g * SPREAD) >> U64(64 - BITS)]
    total = np.zeros(len(g) + 1, np.int32)
    np.cumsum(hit, out=total[1:])
    if len(g) > STRETCH:
        dense = np.flatnonzero((total[STRETCH:] - total[:-STRETCH]) >= items.need)
    else:
        dense = np.zeros(int(total[-1] >= items.need), np.int64)
    if not len(dense):
        return none
    mark = np.bincount(np.maximum(dense - items.reach, 0), minlength=len(g) + 1)
    mark -= np.bincount(np.minimum(dense + STRETCH + items.reach, len(g)), minlength=len(g) + 1)
    at = np.flatnonzero(hit & (np.cumsum(mark)[:-1] > 0))
    left, right = np.searchsorted(items.gram, g[at], "left"), np.searchsorted(items.gram, g[at], "right")
    ok = right > left
    return at[ok], np.stack([left[ok], right[ok]], 1)


def _of_text(items: Items, cp: np.ndarray, where: np.ndarray, at: np.ndarray, span: np.ndarray) -> list[tuple[int, int, int, int]]:
    if not len(at):
        return []
    found: dict[tuple[int, int, int], int] = {}
    for i, low, high in _bands(items, at, span):
        k = int(items.budget[i])
        got = align(items.texts[i], cp, low - k, high + k, k)
        if got:
            key = i, got[1], got[2]
            found[key] = min(got[0], found.get(key, got[0]))
    # Overlapping passages of one item are one match: the one with fewest edits, then the first.
    out: list[tuple[int, int, int, int]] = []
    for (i, s, e), edits in sorted(found.items(), key=lambda x: (x[0][0], x[1], x[0][1], x[0][2])):
        if not any(o[0] == i and s < o[3] and o[2] < e for o in out):
            out.append((i, edits, s, e))
    return [(i, edits, int(where[s]), int(where[e - 1]) + 1) for i, edits, s, e in out]


def _search(items: Items):
    def run(batches):
        for b in pieces_of(batches, 1, limit=1 << 20):
            texts = [normalise(t or "") for t in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(cp) for cp, _ in texts])]).astype(np.int64)
            at, span = _hits(items, np.concatenate([cp for cp, _ in texts]), off)
            # Places whose q-gram runs into the next text belong to none.
            doc = np.searchsorted(off, at, side="right") - 1
            whole = at + Q <= off[doc + 1]
            at, span, doc = at[whole], span[whole], doc[whole]
            keys, rows = b.column(0).to_pylist(), []
            for d in np.unique(doc).tolist():
                mine = doc == d
                cp, where = texts[d]
                rows += [(keys[d], items.ids[i], edits, s, e) for i, edits, s, e in _of_text(items, cp, where, at[mine] - off[d], span[mine])]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block_chars: int = 4 << 20, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end) for each passage of a document within the edit budget of an item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, start long, end long")
    for got in _blocks(items, rate, block_chars):
        out = out.unionByName(rows.mapInArrow(tidy(_search(got)), "doc_id long, item_id long, edits int, start long, end long"))
    return out


def _blocks(items: DataFrame, rate: float, block_chars: int) -> list[Items]:
    """The items' tables, by blocks of a bounded number of characters."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = max(1, -(-size // block_chars)), []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        got = index(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), rate)
        if got is not None:
            out.append(got)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block_chars: int = 4 << 20, text_col: str = "text") -> DataFrame:
    """The documents that hold no passage of an item; each block of items filters what the one before left, in one scan."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), rate, block_chars):

        def run(batches, items=items):
            search = _search(items)
            for b in pieces_of(batches, at, limit=1 << 20):
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], ["row", "text"])
                clean = np.ones(b.num_rows, bool)
                for found in search(iter([numbered])):
                    clean[found.column(0).to_numpy()] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

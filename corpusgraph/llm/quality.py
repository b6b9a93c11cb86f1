"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives shares of character kinds, word lengths and repetition (no language, source or id). Features are cut
into quantile bins. Boosting goes round the features in turn, each step a tree of up to three leaves on one feature's
bins, added to that feature's lookup table; then the pairs with the largest gain on a coarse grid get tables of
their own, grown by four-leaf trees. A score is the logistic function of the intercept plus one table entry for
each feature and pair.

The fit uses a sample of labelled rows, `rows` at most, none of them held out. Scoring reads whole texts.

Defined results: null and empty texts have all features 0; without labels of both kinds every score is the share of
label 1 (0.5 without any); equal texts get equal scores; ids may repeat or be null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import U64, key_mod, labelled_sample, mix, pieces_of, split_words, table, tidy, whole_windows, window_hashes, word_hashes

KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "exclamation", "bar", "symbol", "other", "wide")
NAMES = (*(k for k in KINDS if k not in ("lower", "space")), "log_words", "word_length", "short_words", "long_words",
         "distinct_words", "same_as_previous", "top_word", "distinct_triples")


def _kind_table() -> np.ndarray:
    t = np.full(256, KINDS.index("other"), np.uint8)
    for chars, kind in ((range(97, 123), "lower"), (range(65, 91), "upper"), (range(48, 58), "digit"), (b" \t\r\x0b\x0c", "space"),
                        (b"\n", "newline"), (b".,;:?", "stop"), (b"!", "exclamation"), (b"|", "bar"), (b"#$%&*@^~=+<>{}[]\\/_`", "symbol"), (range(128, 256), "wide")):
        t[list(chars)] = KINDS.index(kind)
    return t


def features(texts: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy()
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    kind = _kind_table()[raw]
    counts = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * len(KINDS), size) + kind, minlength=n * len(KINDS)).reshape(n, -1)
    shares = counts / np.maximum(size, 1)[:, None]
    words, off = split_words(texts, lower=True)
    many = np.diff(off)
    doc = np.repeat(np.arange(n), many)
    length = pc.binary_length(words).to_numpy()
    h = word_hashes(words)
    per = np.maximum(many, 1)
    by = lambda x: np.bincount(doc, x, n) / per
    key = np.sort((doc.astype(U64) << U64(52)) | (mix(h) >> U64(12)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    of = (key[first] >> U64(52)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, np.diff(np.append(first, len(key))))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    start, of3 = whole_windows(off, 3)
    triple = np.unique((of3.astype(U64) << U64(52)) | (window_hashes(h, 3)[start] >> U64(12))) if len(start) else np.zeros(0, U64)
    threes = np.maximum(many - 2, 0)
    columns = [shares[:, i] for i, k in enumerate(KINDS) if k not in ("lower", "space")]
    columns += [np.log1p(many), by(length), by(length <= 3), by(length >= 13), np.bincount(of, minlength=n) / per, by(same), top / per,
                np.bincount((triple >> U64(52)).astype(np.int64), minlength=n) / np.maximum(threes, 1)]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Additive:
    """Bin edges by feature, a table for each feature and for each pair of features, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))


def _leaf(g, h, ridge):
    return g / (h + ridge)


def _line(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The values of a tree of three leaves at most over ordered bins with gradient and hessian sums g, h."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), ridge))
    spans = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for a, b in spans:
            left, lh = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(left):
                s, sh = g[a:b].sum(), h[a:b].sum()
                gain = left**2 / (lh + ridge) + (s - left) ** 2 / (sh - lh + ridge) - s**2 / (sh + ridge)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        (a, b), cut = best[1], best[2]
        spans.remove((a, b))
        for s, e in ((a, cut), (cut, b)):
            spans.append((s, e))
            out[s:e] = _leaf(g[s:e].sum(), h[s:e].sum(), ridge)
    return out


def _grid(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cross of one cut on each axis: gain, and the values of its four leaves over the grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    part = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gs, hs = part(cg), part(ch)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    v = [_leaf(a[i, j], b[i, j], ridge) for a, b in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, pair_rounds: int = 60, pairs: int = 8, bins: int = 48, coarse: int = 8,
        rate: float = 0.1, ridge: float = 5.0) -> Additive:
    """Cyclic boosting of the logistic loss."""
    p = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        even = np.zeros(0, np.float32)
        return Additive([even] * p, [np.zeros(1)] * p, intercept=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    edges = [_cuts(x[:, j], bins) for j in range(p)]
    where = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], [_cuts(x[:, j], coarse) for j in range(p)], intercept=float(np.log(share / (1 - share))))
    f = np.full(len(y), model.intercept)
    slope = lambda: (y - (q := 1 / (1 + np.exp(-f))), q * (1 - q))
    for _ in range(rounds):
        for j in range(p):
            g, h = slope()
            size = len(edges[j]) + 1
            step = rate * _line(np.bincount(where[j], g, size), np.bincount(where[j], h, size), ridge)
            model.tables[j] += step
            f += step[where[j]]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sums = lambda i, j, w: np.bincount(rough[i] * (len(model.coarse[j]) + 1) + rough[j], w, (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)).reshape(len(model.coarse[i]) + 1, -1)
    g, h = slope()
    ranked = sorted(itertools.combinations(range(p), 2), key=lambda ij: -_grid(sums(*ij, g), sums(*ij, h), ridge)[0])[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slope()
            step = rate * _grid(sums(i, j, g), sums(i, j, h), ridge)[1]
            t += step
            f += step[rough[i], rough[j]]
    return model


def _features(batches):
    for b in pieces_of(batches, 1):
        x = features(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = 20_000) -> Additive:
    """Fit on at most `rows` labelled documents that are not held out."""
    got = labelled_sample(docs, labels, label, rows).mapInArrow(tidy(_features), "doc_id long, label int, x array<float>").toPandas()
    got = got.sort_values(["doc_id", "label"])
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(NAMES))
    return fit(x, got["label"].to_numpy(np.float64))


def classify(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of the documents, and score and predicted (these names replace columns of the same name)."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*keep)
    at = keep.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in pieces_of(batches, at):
            s = model.score(features(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(tidy(run), schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (key_mod("doc_id") == 0).alias("held_out"), "score", "predicted")

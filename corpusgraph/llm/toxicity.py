"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, clause end); all others leave every state as it is. Three
transducers are composed into one machine: negation marks what follows it in its clause, reported speech likewise,
and targets mark clauses aimed at someone. At a clause's end the machine emits one pattern for the clause: which of
insult and threat matched, whether negated, reported, aimed. A clause weighs the sum of its words' weights times
the pattern's factor; a text is scored by logistic regression on sums over its clauses, not on single words.

Function words (targets, negation, report, intent) are fixed lists in four languages, some of two words. Insults and threats, with their
weights, are learned: log ratios of document frequencies in toxic and other labelled texts, over a sample of labelled rows of
which none is held out (`rows` at most); beginnings of words are learned like words, for inflected forms. Words that are not nearly
exclusive to toxic texts, or whose ratio chance could explain, stay out. A learned word is a threat if half of the toxic texts
that have it have it after a word of intent in one clause, and an insult otherwise. The factors of negated, reported, aimed and threatening clauses
are fitted to the sample by likelihood; each stays at its first value where the sample says nothing of it.

Defined results: null and empty texts match nothing and get the base score; without labels of both kinds scores are the
share of label 1 (0.5 without any); equal texts get equal scores; ids may repeat or be null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_mod, labelled_sample, pieces_of, split_words, table

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Function words that direct, negate or report a clause (English, German, French, Spanish).
TARGETS = "you your yours he she they them him her du dich dir ihr euch er sie tu te toi vous il elle ils tú usted ustedes ella ellos"
NEGATIONS = "not no never nor neither isn't aren't don't nicht kein keine nie niemals ne pas jamais ni nunca jamás"
REPORTS = "said says called reported quoted wrote sagte sagt nannte dit disait appelé dijo dice llamó"
THREATS = "kill hurt destroy beat töten tuer matar"
INTENTS = frozenset("will gonna shall i'll we'll werde werden vais allons voy vamos".split())
#: Pairs of adjacent words that report or negate a clause.
PHRASES = {"according to": "report", "far from": "negation", "anything but": "negation"}
CLASSES = {w: c for words, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words.split()}
FIRSTS = frozenset(k.split()[0] for k in PHRASES)
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
STOPS = tuple(".,;:!?")
PAIRS = {tuple(k.split()): {"report": REPORT, "negation": NEGATION}[v] for k, v in PHRASES.items()}


@dataclass(frozen=True)
class Transducer:
    """step[(state, symbol)] = (state, mark); a symbol without an entry leaves the state and gets no mark."""

    states: int
    step: dict[tuple[int, int], tuple[int, int]]

    def go(self, state: int, symbol: int) -> tuple[int, int]:
        return self.step.get((state, symbol), (state, 0))


def switch(opener: int, mark: int) -> Transducer:
    """From `opener` to the clause's end, insults and threats get the mark."""
    step = {(s, END): (0, 0) for s in (0, 1)} | {(0, opener): (1, 0)}
    return Transducer(2, step | {(1, s): (1, mark) for s in (INSULT, THREAT)})


def once(symbol: int, mark: int) -> Transducer:
    """Whether the clause has the symbol, told by a mark at its end."""
    return Transducer(2, {(0, symbol): (1, 0), (1, END): (0, mark), (0, END): (0, 0)})


def compose(parts: list[Transducer]) -> Transducer:
    """One machine that runs all parts on each symbol; marks are bits and add up."""
    out = Transducer(1, {})
    for t in parts:
        step = {}
        for a in range(out.states):
            for b in range(t.states):
                for s in range(END + 1):
                    (x, m), (y, n) = out.go(a, s), t.go(b, s)
                    step[a * t.states + b, s] = (x * t.states + y, m | n)
        out = Transducer(out.states * t.states, step)
    return out


NEGATED, REPORTED, AIMED, INSULTED, THREATENED = 1, 2, 4, 8, 16
GRAMMAR = compose([switch(NEGATION, NEGATED), switch(REPORT, REPORTED), once(TARGET, AIMED), once(INSULT, INSULTED), once(THREAT, THREATENED)])
#: First values of the factors of a clause that negates, reports or aims its insults, or that threatens.
FACTOR = {NEGATED: 0.5, REPORTED: 0.6, AIMED: 1.25, THREATENED: 1.0}
#: Factors of a grammar that sees words only.
WORDS_ONLY = dict.fromkeys(FACTOR, 1.0)
#: Values tried for each factor: negation and report never add, aim and threat never take away.
TRIED = {NEGATED: (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), REPORTED: (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), AIMED: (1.0, 1.25, 1.5, 2.0, 3.0), THREATENED: (1.0, 1.25, 1.5, 2.0, 3.0)}
#: A factor moves for so much log likelihood at least.
GAIN = 2.0
#: The bits of a clause that factors look at; a text is summed by each of their combinations.
BITS = tuple(FACTOR)
PATTERNS = 1 << len(BITS)
HAS = np.array([[n >> i & 1 for i in range(len(BITS))] for n in range(PATTERNS)], bool)
FEATURES = ("weight", "clauses", "density", "strongest", "words", "aimed", "threatened")
#: Per pattern the weight and the heaviest clause, then clauses, matched words and words.
SUMS = 2 * PATTERNS + 3


def factors_of(factor: dict[int, float]) -> np.ndarray:
    """The factor of each pattern: the product of those of its bits."""
    return np.where(HAS, [factor[b] for b in BITS], 1.0).prod(axis=1)


def weigh(sums: np.ndarray, factor: dict[int, float]) -> np.ndarray:
    """Features of texts from the sums of their clauses."""
    f = factors_of(factor)
    by, heaviest, (found, n, words) = sums[:, :PATTERNS] * f, sums[:, PATTERNS : 2 * PATTERNS] * f, sums[:, 2 * PATTERNS :].T
    of = lambda bit: by[:, HAS[:, BITS.index(bit)]].sum(axis=1)
    return np.column_stack([np.log1p(by.sum(axis=1)), np.log1p(found), np.log1p(100 * n / np.maximum(words, 1)), heaviest.max(axis=1), np.log1p(n),
                            np.log1p(of(AIMED)), np.log1p(of(THREATENED))])


def clauses(symbols: list[int], weights: list[float]) -> list[tuple[int, float, int]]:
    """(pattern, weight of its words, matched words) of each clause that matches."""
    out, state, marks, total, n = [], 0, 0, 0.0, 0
    for s, w in zip([*symbols, END], [*weights, 0.0], strict=True):
        state, m = GRAMMAR.go(state, s)
        marks |= m
        if s in (INSULT, THREAT):
            total, n = total + w, n + 1
        elif s == END:
            if n:
                out.append((marks, total, n))
            marks, total, n = 0, 0.0, 0
    return out


def core(word: str) -> str:
    m = CORE.search(word)
    return m[0] if m else ""


def stems(word: str) -> list[str]:
    """The word's beginnings of 6, 5 and 4 letters, as entries of a lexicon, if more letters follow."""
    return [f"{word[:n]}*" for n in (6, 5, 4) if len(word) > n]


@dataclass
class Grammar:
    """Weighted insults and threats, and the logistic weights over clause sums."""

    lexicon: dict[str, float] = field(default_factory=dict)
    threats: frozenset[str] = frozenset()
    factor: dict[int, float] = field(default_factory=lambda: dict(FACTOR))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def sums(self, texts: pa.Array) -> np.ndarray:
        """What the clauses of each text add up to, before factors."""
        words, off = split_words(texts, lower=True)
        coded = words.dictionary_encode()
        symbol, weight = np.zeros(len(coded.dictionary), np.int8), np.zeros(len(coded.dictionary))
        ends, leads, names = np.zeros(len(coded.dictionary), bool), np.zeros(len(coded.dictionary), bool), []
        for i, w in enumerate(coded.dictionary.to_pylist()):
            ends[i] = w.endswith(STOPS)
            k = w if w in self.lexicon or w in CLASSES else core(w)
            names.append(k)
            leads[i] = k in FIRSTS and not ends[i]
            if k not in self.lexicon and k not in CLASSES:
                k = next((x for x in stems(k) if x in self.lexicon), k)
            if k in self.lexicon:
                symbol[i], weight[i] = (THREAT if CLASSES.get(k) == THREAT or k in self.threats else INSULT), self.lexicon[k]
            elif k in CLASSES and CLASSES[k] != THREAT:
                symbol[i] = CLASSES[k]
        code = coded.indices.to_numpy()
        at = symbol[code]
        starts = np.zeros(len(code) + 1, bool)
        starts[off] = True
        for i in np.flatnonzero(leads[code[:-1]] & ~starts[1:-1] & (at[1:] == OTHER)).tolist():
            at[i + 1] = PAIRS.get((names[code[i]], names[code[i + 1]]), OTHER)
        hit = (at == INSULT) | (at == THREAT)
        before = np.concatenate([[0], np.cumsum(hit)])
        x = np.zeros((len(texts), SUMS))
        x[:, -1] = np.diff(off)
        for i in np.flatnonzero(before[off[1:]] > before[off[:-1]]):
            c, t = code[off[i] : off[i + 1]], at[off[i] : off[i + 1]]
            told = (t != OTHER) | ends[c]
            s, w = [], []
            for a, b, e in zip(t[told].tolist(), weight[c[told]].tolist(), ends[c[told]].tolist(), strict=True):
                if a:
                    s.append(a)
                    w.append(b)
                if e:
                    s.append(END)
                    w.append(0.0)
            for marks, total, n in clauses(s, w):
                p = sum(1 << j for j, bit in enumerate(BITS) if marks & bit)
                x[i, p] += total
                x[i, PATTERNS + p] = max(x[i, PATTERNS + p], total)
                x[i, -3] += 1
                x[i, -2] += n
        return x

    def score(self, texts: pa.Array) -> np.ndarray:
        z = weigh(self.sums(texts), self.factor) @ self.beta[1:] + self.beta[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes first. Where a few labels
    speak against all others a whole step may overshoot without return, so each is halved until the loss does not rise."""
    share = float(y.mean()) if len(y) else 0.5
    beta = np.zeros(x.shape[1] + 1)
    beta[0] = np.log((share + 1e-6) / (1 - share + 1e-6))
    if not len(y) or share in (0.0, 1.0):
        return beta
    a = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float(np.logaddexp(0, z).sum() - z @ y + 0.5 * b @ penalty @ b)

    least = loss(beta)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + penalty, a.T @ (y - q) - penalty @ beta)
        while (after := loss(beta + step)) > least and np.abs(step).max() >= 1e-8:
            step /= 2
        if after > least:
            break
        beta, least = beta + step, after
        if np.abs(step).max() < 1e-8:
            break
    return beta


def intended(words: list[str]) -> set[str]:
    """The words that come after one of intent in their clause."""
    out, on = set(), False
    for w in words:
        c = core(w)
        if on and c:
            out.add(c)
        on = (on or c in INTENTS) and not w.endswith(STOPS)
    return out


def _terms(batches):
    """Document frequencies of words in texts of either label, and in toxic ones after words of intent, summed over a batch."""
    names, kinds = ["term", "toxic", "clean", "meant"], (pa.string(), pa.int64(), pa.int64(), pa.int64())
    for b in pieces_of(batches, 1):
        seen, meant = (Counter(), Counter()), Counter()
        for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            cut = (text or "").encode().lower().decode().split()
            words = {core(w) for w in cut}
            seen[int(label == 1)].update(words.union(*map(stems, words)))
            if label == 1:
                after = intended(cut)
                meant.update(after.union(*map(stems, after)))
        terms = [t for t in seen[0].keys() | seen[1].keys() if t]
        cols = terms, [seen[1][t] for t in terms], [seen[0][t] for t in terms], [meant[t] for t in terms]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _loss(sums: np.ndarray, y: np.ndarray, factor: dict[int, float]) -> float:
    """What the fitted regression leaves unexplained, in log likelihood; moving a factor away from its first value costs a little."""
    x = weigh(sums, factor)
    beta = logistic(x, y)
    z = np.clip(x @ beta[1:] + beta[0], -30, 30)
    away = sum(np.log((factor[b] + 0.1) / (FACTOR[b] + 0.1)) ** 2 for b in BITS)
    return float(np.logaddexp(0, z).sum() - z @ y + 0.5 * beta[1:] @ beta[1:] + away)


def fit_factors(sums: np.ndarray, y: np.ndarray) -> dict[int, float]:
    """Factors of the patterns, one after another and twice over; one moves only where the sample has clauses of its pattern."""
    factor = dict(FACTOR)
    if not 0 < y.sum() < len(y):
        return factor
    least = _loss(sums, y, factor)
    for _ in range(2):
        for i, bit in enumerate(BITS):
            if not sums[:, :PATTERNS][:, HAS[:, i]].any():
                continue
            best, value = min((_loss(sums, y, factor | {bit: v}), v) for v in TRIED[bit])
            if best < least - GAIN:
                least, factor[bit] = best, value
    return factor


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = 20_000, evidence: float = 28.0, purity: float = 0.8, lexicon: int = 5000, factor: dict[int, float] | None = None) -> Grammar:
    """Learn at most `lexicon` weighted words and the clause weights from at most `rows` labelled documents. factor: taken
    as given (WORDS_ONLY for a grammar without patterns) in place of fitted."""
    sample = labelled_sample(docs, labels, label, rows)
    n = sample.groupBy("label").count().collect()
    toxic, clean = sum(r["count"] for r in n if r["label"] == 1), sum(r["count"] for r in n if r["label"] != 1)
    counted = sample.mapInArrow(_terms, "term string, toxic long, clean long, meant long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "meant")))
    chosen = counted.where((F.col("toxic") >= 2) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("clean"))))
    # Twice the log likelihood ratio against one rate for all words; chance alone reaches 28 for one word in ten million.
    base = toxic / max(toxic + clean, 1)
    side = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (F.col("toxic") + F.col("clean")) / p)).otherwise(0.0)
    if 0 < base < 1:
        chosen = chosen.where(2 * (side("toxic", base) + side("clean", 1 - base)) >= evidence)
    chosen = chosen.orderBy(F.desc("toxic"), "clean", "term").limit(lexicon).collect()
    ratio = lambda r: float(np.log((r["toxic"] + 0.5) / (toxic + 1)) - np.log((r["clean"] + 0.5) / (clean + 1)))
    grammar = Grammar({r["term"]: ratio(r) for r in chosen if r["term"] not in CLASSES or CLASSES[r["term"]] == THREAT})
    grammar.threats = frozenset(r["term"] for r in chosen if 2 * r["meant"] >= r["toxic"])
    learned = grammar.lexicon, grammar.threats

    def measured(batches):
        own = Grammar(*learned)
        for b in pieces_of(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(own.sums(b.column(1))), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sample.mapInArrow(measured, "doc_id long, label int, x array<double>").toPandas()
    sums, y = np.array(got["x"].tolist(), float).reshape(len(got), SUMS), (got["label"].to_numpy() == 1).astype(float)
    order = np.lexsort((*sums.T, y))  # by value, so that sums come out alike at any partitioning
    sums, y = sums[order], y[order]
    grammar.factor = fit_factors(sums, y) if factor is None else dict(factor)
    grammar.beta = logistic(weigh(sums, grammar.factor), y)
    return grammar


def classify(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): of every whole text."""

    def run(batches):
        for b in pieces_of(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grammar.score(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (key_mod("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""LM scoring with a small causal self-attention model trained in numpy.

Words are lower-cased (A-Z) and cut into byte-level subwords; a text is its words and one end. A place stands for one of
these tokens: it takes in the subword ids of the token before (the first and the last of its subwords), one block of
masked self-attention looks over the places up to it, and the output is a law over CLASSES classes of the next token. A
word's class follows from its subwords alone: each frequent subword has an affinity to each class, by what stands beside
it, and the sum over the word's first and last one decides; the end has a class of its own.

A token's chance is P(class) * (c - DISCOUNT) / M, with its count c, if it has one, and its class's tokens M in the
training texts, plus E * S: E is the chance, over all classes, of what the discounts leave, and S the chance that its
subwords are spelt: a first one, each after the one before, and a stop. Both parts together sum to 1 over all words and the end. A text's score is the sum of its tokens' log10 chances.
Texts are scored in overlapping windows: each window of WINDOW places brings STRIDE new ones with at least
WINDOW - STRIDE before them, and each token is scored once.

Training texts are those whose crc32(id) mod 5 is not 1. All texts are cut into subwords once and stored in groups of bounded
size by hash of id and text, in the order of that hash, each a dictionary of words and places in it. Passes over the
training texts of all groups give the subword counts (and from them the rows of the embedding), what stands beside
frequent subwords (the classes), how words are spelt (each word of a group once) and the weights: each group trains from
the same weights, and results are averaged by share of windows in whole numbers, in two steps, so the model depends
neither on partitions nor on retries. An opening round on one window in OPENING of every group comes before the round
over every window. What reaches the driver has the size of the model and of the subword vocabulary, both fixed.

Counts of words over all training texts are a table that grows. It is not broadcast: each group asks for its distinct
words in packed rows, one for each partition of the hash space, which sums the counts and answers in kind. Words are told
apart by 59 bits of hash and their class.

Defined results: null and empty texts are one end; repeated ids are scored row by row; a null id counts as empty text in
the split; without training texts N = V = 0, all words are spelt and the model stays untrained; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import VOCABULARY, encoder
from .common import U64, forget, give_back, key_mod, mix, pieces_of, shared_dir, shuffle_partitions, split_words, steady_heap, stored, table, tidy, worker_cache

SUBWORDS = 50257
WINDOW, STRIDE, WIDTH, HIDDEN, CLASSES, ROWS = 32, 16, 16, 32, 32, 4096
#: The class of the end of a text, the last one, and its hash.
END_CLASS, END_HASH = CLASSES - 1, U64(CLASSES - 1)
#: Rows of the embedding for what is no subword.
OPEN, ENDED = ROWS, ROWS + 1
#: Frequent subwords, which have affinities, and the most frequent ones, which are told apart as neighbours.
COMMON, NEAR = 4096, 64
#: Training is over every window; the opening round before it is over one window in so many.
OPENING = 16
GROUP_BYTES = 8 << 20
BLOCK = 8192
#: Weights are averaged as whole multiples of this.
STEP = 2.0**-16
#: Name of a worker's cache of which subwords begin with a space.
BEGINS = "subwords that begin words"
#: What each word's count gives up to words that are spelt.
DISCOUNT = 0.7
#: In the law of spelling: subwords that stand for themselves before another and after one, bands of others after one,
#: and how much their share at large weighs against what followed.
PREV, NEXT, BANDS, PULL = 1024, 900, 124, 4.0
GROUPS = NEXT + BANDS


@dataclass
class Words:
    """Distinct words as their subwords in a row, and the places of texts as numbers of words (-1: end).

    starts: where each text's places start, one entry more than texts."""

    subs: np.ndarray
    size: np.ndarray
    code: np.ndarray
    starts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def slices(self, places: int = 1 << 18) -> Iterator[tuple[int, Words]]:
        """The same words with about so many places at a time, whole texts each; also where in all places they start."""
        at = np.flatnonzero(np.diff(self.starts[:-1] // places, prepend=-1))
        for a, z in zip(at, [*at[1:], len(self.starts) - 1], strict=True):
            s = self.starts[a : z + 1]
            yield int(s[0]), Words(self.subs, self.size, self.code[s[0] : s[-1]], s - s[0])

    def each(self, tell, kind, step: int = 1 << 15) -> np.ndarray:
        """What `tell` tells of each distinct word, from so many words at a time: their subwords, sizes and first places."""
        if not len(self.size):
            return np.zeros(0, kind)
        edge = np.concatenate([[0], np.cumsum(self.size)])
        some = ((a, min(a + step, len(self.size))) for a in range(0, len(self.size), step))
        return np.concatenate([tell(self.subs[edge[a] : edge[z]], self.size[a:z], edge[a:z] - edge[a]) for a, z in some])

    def spread(self, each: np.ndarray, end) -> np.ndarray:
        """A value of each word, by place."""
        return np.append(each, np.asarray(end, each.dtype))[self.code]

    def stream(self) -> np.ndarray:
        """All places' subwords in order, -1 for ends."""
        size = np.append(self.size, 1)[self.code]
        at = np.cumsum(size) - size
        first = np.append(self.first, len(self.subs))[self.code]
        return np.append(self.subs, -1)[np.arange(int(size.sum())) - np.repeat(at - first, size)]


def spell(words: list[str], path: str = VOCABULARY, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """The subwords of words in a row, and how many each word has.

    Words are encoded together, with a space before each: the pattern of the encoding starts anew at every single space, so
    they come out as they would alone, and a subword that begins with a space begins a word. Only words that hold spaces
    of other kinds could meet in one match; they go one by one."""
    encode, begins = encoder(path).encode_ordinary, _begins(path)
    subs, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some in (words[a : a + step] for a in range(0, len(words), step)):
        said = " ".join(some)
        if said.split() == some:
            ids = np.array(encode(" " + said), np.int64)
            size.append(np.diff(np.flatnonzero(begins[ids]), append=len(ids)))
        else:
            each = [encode(" " + w) for w in some]
            ids = np.array([i for x in each for i in x], np.int64)
            size.append(np.fromiter(map(len, each), np.int64, len(each)))
        subs.append(ids)
    return np.concatenate(subs), np.concatenate(size)


def _begins(path: str) -> np.ndarray:
    """Which subwords begin with a space."""
    cache = worker_cache().setdefault(BEGINS, {})
    if path not in cache:
        known = encoder(path)
        cache[path] = np.array([known.decode_single_token_bytes(i)[:1] == b" " for i in range(known.n_vocab)])
    return cache[path]


def cut(texts: pa.Array) -> tuple[Words, pa.Array]:
    """The words and places of texts; also the distinct words."""
    words, off = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    code = np.insert(coded.indices.to_numpy().astype(np.int64), off[1:], -1)
    return Words(*spell(coded.dictionary.to_pylist()), code, off + np.arange(len(off))), coded.dictionary


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts from starts[i] to starts[i+1]: each window's text, its first new place, and how many new places it has."""
    n = np.diff(starts)
    many = -(-n // STRIDE)
    doc = np.repeat(np.arange(len(n)), many)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = starts[:-1][doc] + turn * STRIDE
    return doc, first, np.minimum(starts[1:][doc] - first, STRIDE)


@dataclass
class Model:
    """Weights; the row and the affinities of each subword; the law of spelling: each subword's group and log10 share in
    it, and log10 chances of groups and the stop after each frequent subword."""

    w: dict[str, np.ndarray]
    row: np.ndarray
    affinity: np.ndarray
    group: np.ndarray
    share: np.ndarray
    after: np.ndarray
    prev: np.ndarray

    def light(self) -> Model:
        """The model without the law of spelling, for steps that spell nothing."""
        return Model(self.w, self.row, self.affinity, self.group, np.zeros(0), np.zeros(0), self.prev)

    def classes(self, words: Words) -> np.ndarray:
        """The class of each distinct word, by its first and last subword; in whole numbers, so it is the same everywhere."""
        return words.each(lambda s, size, first: np.argmax(self.affinity[s[first]] + self.affinity[s[first + size - 1]], axis=1), np.int64)

    def spelt(self, words: Words) -> np.ndarray:
        """log10 chance that each distinct word's subwords are spelt, stop included."""

        def tell(s, size, first):
            before = np.empty(len(s), np.int64)
            before[1:] = self.prev[s[:-1]]
            before[first] = PREV + 1
            gain = self.after[before, self.group[s]] + self.share[s]
            return np.add.reduceat(gain, first) + self.after[self.prev[s[first + size - 1]], GROUPS]

        return words.each(tell, np.float64)

    def inputs(self, words: Words) -> np.ndarray:
        """Two rows of the embedding for each place: the first and the last subword of the token before."""
        row, at = self.row.astype(np.int16), words.first
        first, last = row[words.subs[at]], row[words.subs[at + words.size - 1]]
        own = np.stack([words.spread(first, ENDED), words.spread(last, ENDED)])
        before = np.concatenate([own[:, :1], own[:, :-1]], axis=1)
        before[:, words.starts[:-1]] = OPEN
        return before

    def seen(self, rows: np.ndarray, starts: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows by window and place; places before a text are its opening."""
        place = first[:, None] + np.arange(STRIDE - WINDOW, STRIDE)
        lead = place < starts[:-1][doc][:, None]
        out = rows.take(place, 1, mode="clip").astype(np.intp)
        out[:, lead] = OPEN
        return out

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Chances of classes at the last STRIDE places of each window. Places lie end to end but where windows look at
        their own, so a layer is one product of two matrices and not one for each window."""
        w, n = self.w, rows.shape[1]
        x = w["embed"].take(rows[0].reshape(-1), 0)
        x += w["embed"].take(rows[1].reshape(-1), 0)
        by = x.reshape(n, WINDOW, WIDTH)
        by += w["place"]
        new = by[:, WINDOW - STRIDE :].reshape(-1, WIDTH)  # only these places ask; those before are asked
        kv = (x @ np.concatenate([w["k"], w["v"]], axis=1)).reshape(n, WINDOW, 2 * WIDTH)
        q, k, v = (new @ (w["q"] * SOFTEN)).reshape(n, STRIDE, WIDTH), kv[:, :, :WIDTH], kv[:, :, WIDTH:]
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -CAP, CAP, out=a)
        np.exp(a, out=a)
        a *= MASK
        _evened(a.reshape(-1, WINDOW))
        c = (a @ v).reshape(-1, WIDTH)
        y = c @ w["o"]
        y += new
        h = y @ w["up"]
        h += w["up_bias"]
        np.maximum(h, 0, out=h)
        z = h @ w["down"]
        z += y
        p = z @ w["out"]
        p += w["out_bias"]
        np.clip(p, -CAP, CAP, out=p)
        np.exp(p, out=p)
        _evened(p)
        return p.reshape(n, STRIDE, CLASSES), (x, new, q, k, v, a, c, y, h, z)

    def chances(self, words: Words, rare: np.ndarray, batch: int = 128, k: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """By place: the chance of the token's class, and that of a word that is spelt (rare: its chance by class)."""
        rows, starts = self.inputs(words), words.starts
        target = words.spread(self.classes(words) if k is None else k, END_CLASS)
        doc, first, new = windows(starts)
        own, open_ = np.empty(len(target)), np.empty(len(target))
        places, rare = np.arange(STRIDE), rare.astype(np.float32)
        for a in range(0, len(doc), batch):
            i = slice(a, a + batch)
            p, _ = self.forward(self.seen(rows, starts, doc[i], first[i]))
            at = first[i][:, None] + places
            real = places < new[i][:, None]
            hit = np.take_along_axis(p, target[np.minimum(at, len(target) - 1)][:, :, None], 2)[:, :, 0]
            own[at[real]] = hit[real]
            open_[at[real]] = (p @ rare)[real]
        return own, open_

    def score(self, words: Words, count: np.ndarray, mass: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """log10 chance of the token at each place. count: of each distinct word; mass: tokens of each class."""
        k, spelt = self.classes(words), self.spelt(words)
        known = np.where(count > 0, (count - DISCOUNT) / np.maximum(mass[k], 1), 0)
        said = 10.0 ** np.maximum(spelt, -300)
        out = np.empty(len(words.code))
        for at, part in words.slices(1 << 16):
            own, open_ = self.chances(part, rare, k=k)
            chance = own * part.spread(known, 1.0) + open_ * part.spread(said, 0.0)
            told = np.log10(np.maximum(chance, 1e-300))
            # A word of thousands of subwords has a chance below the smallest float; its logarithm is known all the same.
            tiny = np.flatnonzero(chance < 1e-290)
            told[tiny] = np.log10(open_[tiny] + 1e-300) + part.spread(spelt, 0.0)[tiny]
            out[at : at + len(told)] = told
        return out

    def gradient(self, rows: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over real places, and its gradient."""
        w, n = self.w, rows.shape[1]
        p, (x, new, q, k, v, a, c, y, h, z) = self.forward(rows)
        p, at, real = p.reshape(-1, CLASSES), np.arange(n * STRIDE) * CLASSES + target.reshape(-1), real.reshape(-1)
        hit = p.reshape(-1)[at]
        many = max(int(real.sum()), 1)
        loss = float(-np.log(np.maximum(hit, 1e-12))[real].sum() / many)
        p.reshape(-1)[at] = hit - 1
        p *= (real / np.float32(many))[:, None]
        g = {"out": z.T @ p, "out_bias": p.sum(0)}
        dz = p @ w["out"].T
        dh = dz @ w["down"].T
        dh *= h > 0
        g |= {"down": h.T @ dz, "up": y.T @ dh, "up_bias": dh.sum(0)}
        dy = dh @ w["up"].T
        dy += dz
        dc = dy @ w["o"].T
        g["o"] = c.T @ dy
        c *= dc
        told = (c @ np.ones((WIDTH, 1), c.dtype)).reshape(n, STRIDE, 1)  # what a place's shares must not change together
        dc = dc.reshape(n, STRIDE, WIDTH)
        dkv = np.empty((n, WINDOW, 2 * WIDTH), x.dtype)
        np.matmul(a.transpose(0, 2, 1), dc, out=dkv[:, :, WIDTH:])
        da = dc @ v.transpose(0, 2, 1)
        da -= told
        da *= a
        np.matmul(da.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
        dkv = dkv.reshape(-1, 2 * WIDTH)
        dq, both = (da @ k).reshape(-1, WIDTH), x.T @ dkv
        g |= {"q": new.T @ dq * SOFTEN, "k": both[:, :WIDTH], "v": both[:, WIDTH:]}
        dx = dkv @ np.concatenate([w["k"], w["v"]], axis=1).T
        dy += dq @ (w["q"] * SOFTEN).T
        by = dx.reshape(n, WINDOW, WIDTH)
        by[:, WINDOW - STRIDE :] += dy.reshape(n, STRIDE, WIDTH)
        g["place"] = by.sum(0)
        # Two columns are one complex number, so they are added up in one pass.
        pairs = np.ascontiguousarray(dx.view(np.result_type(dx, np.complex64)).T)
        sums = np.zeros((len(pairs), ROWS + 2), pairs.dtype)
        for at in rows.reshape(2, -1):
            for column, own in zip(sums, pairs, strict=True):
                np.add.at(column, at, own)
        g["embed"] = np.ascontiguousarray(sums.T).view(dx.dtype)
        return loss, g

    def train(self, words: Words, rate: float, keys: np.ndarray, share: int = 1, salt: int = 0, batch: int = 128) -> int:
        """Adam steps over the texts' windows, in an order (and, of one in `share`, a draw) by the text's key and the
        window's number. Returns how many windows took part."""
        rows, starts = self.inputs(words), words.starts
        aim = words.spread(self.classes(words), END_CLASS)
        doc, first, new = windows(starts)
        turn = (first - starts[:-1][doc]) // STRIDE
        lot = mix(mix(keys[doc] + U64(salt)) + turn.astype(U64))
        if share > 1:
            drawn = lot % U64(share) == 0
            doc, first, new, lot = doc[drawn], first[drawn], new[drawn], lot[drawn]
        order = np.argsort(mix(lot), kind="stable")
        doc, first, new = doc[order], first[order], new[order]
        names, places = list(self.w), np.arange(STRIDE)
        w = np.concatenate([self.w[k].reshape(-1) for k in names])  # all weights in a row, so that a step is taken once
        ends = np.cumsum([self.w[k].size for k in names])
        self.w = {k: x.reshape(self.w[k].shape) for k, x in zip(names, np.split(w, ends[:-1]), strict=True)}
        m, v, told = np.zeros_like(w), np.zeros_like(w), np.empty_like(w)
        for t, a in enumerate(range(0, len(order), batch), 1):
            i = slice(a, a + batch)
            target = aim[np.minimum(first[i][:, None] + places, len(aim) - 1)]
            _, g = self.gradient(self.seen(rows, starts, doc[i], first[i]), target, places < new[i][:, None])
            np.concatenate([g[k].reshape(-1) for k in names], out=told)
            # Both means are kept without the factors 0.1 and 0.01, which go into the pace.
            m *= 0.9
            m += told
            told *= told
            v *= 0.99
            v += told
            np.sqrt(v, out=told)
            level = (0.01 / (1 - 0.99**t)) ** 0.5
            told += 1e-8 / level
            np.divide(m, told, out=told)
            told *= rate * 0.1 / (1 - 0.9**t) / level
            w -= told
        return len(order)


#: Which places a new place may look at: itself and those before.
MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))[WINDOW - STRIDE :]
#: Bounds exponents; a bounded logit is still a logit.
CAP = np.float32(50)
#: Scales what places ask.
SOFTEN = np.float32(WIDTH**-0.5)


def _evened(x: np.ndarray) -> None:
    """Divide each row by its sum."""
    x /= x @ np.ones((x.shape[1], 1), x.dtype)


def fresh_weights(seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    normal = lambda *shape: draw.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    return {
        "embed": draw.normal(0, 0.3, (ROWS + 2, WIDTH)).astype(np.float32), "place": draw.normal(0, 0.1, (WINDOW, WIDTH)).astype(np.float32),
        "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH), "o": normal(WIDTH, WIDTH),
        "up": normal(WIDTH, HIDDEN), "up_bias": np.zeros(HIDDEN, np.float32), "down": normal(HIDDEN, WIDTH),
        "out": normal(WIDTH, CLASSES), "out_bias": np.zeros(CLASSES, np.float32),
    }


def used(words: Words) -> Words:
    """The same places with only the words that occur in them."""
    often = np.bincount(words.code[words.code >= 0], minlength=len(words.size)) > 0
    number = np.append(np.cumsum(often) - 1, -1)
    return Words(words.subs[np.repeat(often, words.size)], words.size[often], number[words.code], words.starts)


def sub_counts(words: Words) -> np.ndarray:
    """How often each subword occurs."""
    often = np.bincount(words.code[words.code >= 0], minlength=len(words.size))
    return np.bincount(words.subs, np.repeat(often, words.size), SUBWORDS).astype(np.int64)


def near_counts(counts: np.ndarray, words: Words) -> np.ndarray:
    """For each frequent subword, how often each of the most frequent ones (others, and ends, as one) stands before and after it."""
    rank = np.argsort(-counts, kind="stable")
    wide = 2 * (NEAR + 1)
    slot, mark = np.full(SUBWORDS + 1, COMMON * wide), np.full(SUBWORDS + 1, NEAR)
    slot[rank[:COMMON]] = np.arange(COMMON) * wide
    mark[rank[:NEAR]] = np.arange(NEAR)
    beside = np.zeros((COMMON + 1) * wide, np.int64)  # the last row is of all others and the ends
    for _, part in words.slices():
        ids = np.append(-1, part.stream())  # a text stands after an end
        at, other = slot[ids], mark[ids]
        beside += np.bincount(at[1:] + other[:-1], minlength=len(beside))
        beside += np.bincount(at[:-1] + other[1:] + NEAR + 1, minlength=len(beside))
    return beside.reshape(-1, wide)[:COMMON]


def spell_counts(counts: np.ndarray, group: np.ndarray, words: Words) -> np.ndarray:
    """Over distinct words: how often each subword occurs, and each group (or the stop) after each frequent subword, others and the start."""
    prev, out = _prev(counts), np.zeros(SUBWORDS + (PREV + 2) * (GROUPS + 1), np.int64)
    s, first = words.subs, words.first
    if len(words.size):
        before = np.empty(len(s), np.int64)
        before[1:] = prev[s[:-1]]
        before[first] = PREV + 1
        stop = prev[s[first + words.size - 1]] * (GROUPS + 1) + GROUPS
        pairs = np.concatenate([before * (GROUPS + 1) + group[s], stop])
        out[:SUBWORDS] = np.bincount(s, minlength=SUBWORDS)
        out[SUBWORDS:] = np.bincount(pairs, minlength=len(out) - SUBWORDS)
    return out


def _prev(counts: np.ndarray) -> np.ndarray:
    prev = np.full(SUBWORDS, PREV)
    prev[np.argsort(-counts, kind="stable")[:PREV]] = np.arange(PREV)
    return prev


def spelling_groups(counts: np.ndarray) -> np.ndarray:
    """Each subword's group in the law of spelling: its own if it is frequent, else a band of ranks."""
    rank, group = np.argsort(-counts, kind="stable"), np.empty(SUBWORDS, np.int64)
    group[rank[:NEXT]] = np.arange(NEXT)
    group[rank[NEXT:]] = NEXT + np.arange(SUBWORDS - NEXT) * BANDS // (SUBWORDS - NEXT)
    return group


def untrained(counts: np.ndarray, beside: np.ndarray, seed: int = 6) -> Model:
    """A model with the rows, affinities and groups that the counts give, fresh weights and an even law of spelling.

    Centres of frequent subwords by their neighbours (k-means) are the classes; a subword's affinity to a centre is its nearness."""
    rank, own = np.argsort(-counts, kind="stable"), ROWS - 512
    row = np.empty(SUBWORDS, np.int64)
    row[rank[:own]] = np.arange(own)
    row[rank[own:]] = own + rank[own:] % 512
    x = np.sqrt(beside / np.maximum(beside.sum(1, keepdims=True), 1))
    center = x[np.sort(np.random.default_rng(seed).permutation(min(len(x), 512))[: CLASSES - 1])]
    near = lambda: np.round(1000 * (x @ center.T - (center**2).sum(1) / 2))  # noqa: E731  whole numbers, so that ties are ties
    for _ in range(12):
        of = np.argmax(near(), axis=1)
        for c in range(len(center)):
            if (of == c).any():
                center[c] = x[of == c].mean(0)
    affinity = np.zeros((SUBWORDS, CLASSES - 1), np.int16)
    affinity[rank[:COMMON]] = near()
    model = Model(fresh_weights(), row, affinity, spelling_groups(counts), np.zeros(0), np.zeros(0), _prev(counts))
    return with_spelling(model, np.zeros(SUBWORDS + (PREV + 2) * (GROUPS + 1)))


def with_spelling(model: Model, told: np.ndarray) -> Model:
    """The model with the law of spelling that these counts give."""
    sub, pairs = told[:SUBWORDS] + 0.1, told[SUBWORDS:].reshape(PREV + 2, GROUPS + 1).astype(float)
    plain = pairs.sum(0) + 0.1
    # What followed, drawn to what follows at large; no word is empty, so no stop follows the start.
    pairs[:] = pairs + PULL * plain / plain.sum()
    pairs[PREV + 1, GROUPS] = 0
    with np.errstate(divide="ignore"):
        after = np.log10(pairs / pairs.sum(1, keepdims=True))
    share = np.log10(sub / np.bincount(model.group, sub, GROUPS)[model.group])
    return Model(model.w, model.row, model.affinity, model.group, share, after, model.prev)


def build(texts: list[str]) -> Model:
    """A model of a few texts, without Spark."""
    words, _ = cut(pa.array(texts, pa.string()))
    counts = sub_counts(words)
    model = untrained(counts, near_counts(counts, words))
    model = with_spelling(model, spell_counts(counts, model.group, words))
    model.train(words, 0.01, np.arange(len(texts)).astype(U64), batch=32)
    return model


_GROUP = "grp long, ids binary, sizes binary, codes binary, many binary, keys binary, doc_id array<long>, training long"


def word_keys(words: Words) -> np.ndarray:
    """A hash of each distinct word's subwords, which spell it and no other word."""

    def tell(subs, size, first):
        turn = (np.arange(len(subs)) - np.repeat(first, size)).astype(U64)
        return mix(np.add.reduceat(mix(subs.astype(U64) + mix(turn + U64(1))), first) + size.astype(U64))

    return words.each(tell, U64)


def _packed(rows: pa.Table) -> pa.Table:
    """A group's texts as one row, those of training first, in the order of their keys: a dictionary of words, and places in it."""
    rows = rows.sort_by([("held_out", "ascending"), ("key", "ascending")])
    coded, many = [], []
    for b in pieces_of(rows.to_batches(), rows.schema.get_field_index("text")):
        words, off = split_words(b.column("text"), lower=True)
        coded.append(words.dictionary_encode())
        many.append(np.diff(off))
    coded = pa.chunked_array(coded).unify_dictionaries()  # words are numbered as they come
    code = np.concatenate([x.indices.to_numpy() for x in coded.chunks])
    flat, size = spell(coded.chunk(0).dictionary.to_pylist())
    out = flat.astype("<u2"), size.astype("<u4"), code.astype("<u4"), np.concatenate(many).astype("<i8"), rows.column("key").to_numpy().astype("<i8")
    names = [x.split()[0] for x in _GROUP.split(", ")]
    cols = [rows.column("grp")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in out), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))]
    cols.append(pa.array([rows.num_rows - sum(rows.column("held_out").to_pylist())], pa.int64()))
    del coded, code, flat, out
    give_back()
    return pa.table(dict(zip(names, cols, strict=True)))


def _words(row: dict) -> Words:
    starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["many"], "<i8") + 1)])
    code, inner = np.full(starts[-1], -1), np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    code[inner] = np.frombuffer(row["codes"], "<u4")
    return Words(np.frombuffer(row["ids"], "<u2").astype(np.int64), np.frombuffer(row["sizes"], "<u4").astype(np.int64), code, starts)


def _training(words: Words, many: int) -> Words:
    """The first texts of a group, with all its words."""
    return Words(words.subs, words.size, words.code[: words.starts[many]], words.starts[: many + 1])


def _rows(batches):
    """Stored groups, one at a time; their packed columns are read where they lie."""
    for b in batches:
        for i in range(b.num_rows):
            yield {n: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}


def _groups(batches):
    """Each group's number, and words and keys of its training texts, if it has any."""
    for row in _rows(batches):
        if row["training"]:
            yield row["grp"], used(_training(_words(row), row["training"])), np.frombuffer(row["keys"], "<u8")[: row["training"]]


@contextmanager
def row_by_row(spark: SparkSession, rows: int = 1) -> Iterator[None]:
    """Stored groups, a few MB each, go to Python workers one at a time, not several to a batch; or other rows by so many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_BLOCKS = "block int, salt int, sums binary, n long"


def _blocks(grp: int, flat: np.ndarray, n: int) -> pa.RecordBatch:
    at = range(0, len(flat), BLOCK)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(at), dtype=np.int32)), pa.array([grp % 256] * len(at), pa.int32()), pa.array([flat[a : a + BLOCK].astype("<i8").tobytes() for a in at], pa.binary()), pa.array([n] * len(at), pa.int64())],
        ["block", "salt", "sums", "n"],
    )


def _tables(count):
    """The sum over a task's groups of what `count` tells of each: whole numbers, and how much they count for."""

    def run(batches):
        steady_heap()
        for name in (VOCABULARY, BEGINS):  # no use once all texts are cut
            worker_cache().pop(name, None)
        total, weight, last = 0, 0, 0
        for last, words, keys in _groups(batches):  # noqa: B007
            told, n = count(words, keys)
            total, weight = total + told, weight + n
            del words, keys, told  # before the next group is read
        if np.ndim(total):
            yield _blocks(last, total.reshape(-1), weight)

    return run


def _add(told: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in told.column("sums").to_pylist())
    return pa.table({"block": told.column("block")[:1], "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(told.column("n").to_pylist())], pa.int64())})


def _summed_up(groups: DataFrame, count) -> tuple[np.ndarray | None, int]:
    """The sum of what `count` tells of all groups, block by block and in two steps; it has the size of the model or of a table of counts."""
    told = groups.mapInArrow(tidy(_tables(count)), _BLOCKS)
    for key in (["block", "salt"], ["block"]):
        told = told.groupBy(*key).applyInArrow(_add, _BLOCKS)
    with row_by_row(groups.sparkSession):
        told = sorted(told.collect())
    return (np.concatenate([np.frombuffer(r["sums"], "<i8") for r in told]), told[0]["n"]) if told else (None, 0)


def _trained(model: Model, rate: float, share: int, salt: int):
    """Weights as trained on a group, in steps of STEP, times its share: one for each 64 windows."""
    light = model.light()

    def count(words: Words, keys: np.ndarray):
        own = Model({k: v.copy() for k, v in light.w.items()}, light.row, light.affinity, light.group, light.share, light.after, light.prev)
        many = -(-own.train(words, rate, keys, share, salt) // 64)
        return np.concatenate([np.rint(own.w[k].reshape(-1) / STEP) for k in sorted(own.w)]).astype(np.int64) * many, many

    return count


def grouped(rows: DataFrame, path: str) -> DataFrame:
    """All texts (doc_id, text, held_out) in groups of bounded size, each cut into subwords once, distinct words only, and stored."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // GROUP_BYTES))
    key = F.xxhash64("doc_id", "text")  # the text takes part, so a repeated id does not fill a group
    told = rows.select(F.pmod(key, F.lit(many)).cast("long").alias("grp"), key.alias("key"), "held_out", "doc_id", "text")
    with row_by_row(rows.sparkSession, 256):  # a group's texts leave the JVM by parts
        return stored(told.repartition(many, "grp").groupBy("grp").applyInArrow(_packed, _GROUP), path)


def learn(groups: DataFrame, *, rate: float = 0.004) -> Model:
    """Fit the model to the training texts of stored groups."""
    counts, _ = _summed_up(groups, lambda words, _: (sub_counts(words), 0))
    if counts is None:
        return untrained(np.zeros(SUBWORDS, np.int64), np.zeros((COMMON, 2 * (NEAR + 1))))
    group = spelling_groups(counts)
    both, _ = _summed_up(groups, lambda words, _: (np.concatenate([near_counts(counts, words).reshape(-1), spell_counts(counts, group, words)]), 0))
    beside, told = np.split(both, [COMMON * 2 * (NEAR + 1)])
    model = with_spelling(untrained(counts, beside.reshape(COMMON, -1)), told)
    for turn, (pace, share) in enumerate(((0.01, OPENING), (rate, 1))):
        flat, n = _summed_up(groups, _trained(model, pace, share, turn))
        if n:
            at = 0
            for k in sorted(model.w):
                wide = model.w[k].size
                model.w[k] = (flat[at : at + wide] / n * STEP).astype(np.float32).reshape(model.w[k].shape)
                at += wide
    return model


def marked(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Hashes of distinct words with their classes in the low bits."""
    return keys & ~U64(CLASSES - 1) | k.astype(U64)


def _asked(model: Model, words: Words, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a group's words and of the end, their partitions, and the order in which they are asked for."""
    h = np.append(marked(word_keys(words), model.classes(words)), END_HASH)
    part = ((h >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)  # rises with the hash
    return h, part, np.argsort(h)


def _ask(parts: int, model: Model):
    """Per group and partition of the hash space, the group's distinct words and their counts in training texts."""

    def run(batches):
        for row in _rows(batches):
            words = _words(row)
            h, part, order = _asked(model, words, parts)
            often = np.bincount(words.code[: words.starts[row["training"]]] % len(h), minlength=len(h))
            at = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, row["grp"], h[i].astype("<u8").tobytes(), often[i].astype("<i8").tobytes()) for p in range(parts) if len(i := order[at[p] : at[p + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "grp", "hashes", "counts"])

    return run


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n[order], first)


def _answer(batches):
    """For each partition of the hash space: total counts, told to every group in the order it asked; group -1 gets, of
    each class, the tokens and the words seen."""
    part, rows = None, []
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())

    def told():
        asked = [np.frombuffer(x[1], "<u8") for x in rows]
        h, c = _summed(np.concatenate(asked), np.concatenate([np.frombuffer(x[2], "<i8") for x in rows]))
        out = [(x[0], part, c[np.searchsorted(h, a)].astype("<i8").tobytes(), None) for x, a in zip(rows, asked, strict=True)]
        k = (h & U64(CLASSES - 1)).astype(np.int64)
        sums = [np.bincount(k, x, CLASSES).astype(np.int64) for x in (c, c > 0)]
        out.append((-1, part, b"", np.concatenate(sums).tolist()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "part", "counts", "sums"])

    for b in batches:
        for p, *rest in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if p != part and rows:
                yield told()
                rows = []
            part = p
            rows.append(rest)
    if rows:
        yield told()


def rare_chances(mass: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """What the discounts of each class's words leave of its tokens; 1 for a class never seen. The end is always known."""
    return np.where(np.arange(CLASSES) == END_CLASS, 0.0, np.where(mass > 0, DISCOUNT * seen / np.maximum(mass, 1), 1.0))


def _scored(model: Model, parts: int, mass: np.ndarray, seen: np.ndarray):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    whole, rare = mass.sum() + 0.5 * (seen.sum() + 1), rare_chances(mass, seen)

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        steady_heap()
        row = next(_rows(group.combine_chunks().to_batches()))
        words = _words(row)
        h, _, order = _asked(model, words, parts)
        count = np.empty(len(h), np.int64)
        count[order] = np.frombuffer(b"".join(answers.sort_by("part").column("counts").to_pylist()), "<i8")
        del answers, h, order
        # Sums by text; each has its end.
        known, base = (np.add.reduceat(x[words.code], words.starts[:-1]) for x in ((count > 0).astype(np.int64), np.log10((count + 0.5) / whole)))
        told = np.add.reduceat(model.score(words, count[:-1], mass, rare), words.starts[:-1])
        out = pa.array(row["doc_id"], pa.int64()), pa.array(np.arange(len(told)) >= row["training"]), pa.array(np.diff(words.starts)), pa.array(known), pa.array(base), pa.array(told)
        del row, words
        give_back()
        return pa.table(list(out), names)

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, root = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (key_mod(id_col) == 1).alias("held_out"))
    groups = grouped(rows, f"{root}/groups")
    model = learn(groups)
    # As many partitions of the hash space as groups of texts, so neither grows with the input.
    parts = max(shuffle_partitions(spark), groups.agg(F.coalesce(F.max("grp"), F.lit(0))).first()[0] + 1)
    asked = groups.mapInArrow(tidy(_ask(parts, model.light())), "part int, grp long, hashes binary, counts binary")
    with row_by_row(spark):
        asked = stored(asked, f"{root}/asked")
    told = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(_answer), "grp long, part int, counts binary, sums array<long>")
    told = stored(told, f"{root}/answers")
    forget(spark, f"{root}/asked")
    sums = dict(map(tuple, told.where("grp = -1").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect()))
    mass, seen = np.array([sums.get(i, 0) for i in range(2 * CLASSES)]).reshape(2, CLASSES)
    told = told.where("grp >= 0").select("grp", "part", "counts")
    made = groups.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(
        _scored(model, parts, mass, seen), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(mass.sum())).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

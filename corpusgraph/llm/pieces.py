"""SentencePiece encoding by sampling over the piece lattice, and lossless decoding.

Text becomes pieces with U+2581 for each space and one space put in front. For every place the lattice holds
each vocabulary piece that ends there; a character without a piece takes its UTF-8 bytes as byte pieces. Forward
filtering sums the weights of all ways to reach a place, backward sampling draws the last piece in proportion to
the way it continues, then the one before, so a whole segmentation is drawn with its exact probability. Weights are
those of a Zipf law over the vocabulary's rank order, raised to `alpha` (a large alpha nears the best path).

No piece crosses from a word into the next space or over a line end (checked when the vocabulary is read), so the
lattice of a text is a chain of lattices of words; each distinct word is filtered once and words are sampled apart.
Draws are a hash of seed, row key, word number and step: the same row gives the same pieces at any partitioning.

Decoding joins the pieces, turns U+2581 back to spaces and drops the first; a U+2581 in the text itself is encoded as byte
pieces, so every text survives, whatever its spaces and characters.

Defined results: null and empty texts have no pieces (null decodes to empty); equal rows get equal pieces, equal
texts under other keys others; a null key draws like key 0; an empty table gives an empty result; the columns
pieces, n_pieces and decoded replace columns of the same name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, U64, mix, pieces_of, table, tidy, worker_cache

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(r" *[^ \n]+|\n| +")
#: The unit cache is emptied beyond this many lattice places.
PLACES = 1_800_000
BITS = 22
#: Words sampled together, which bounds the memory that a long text takes.
WORDS = 1 << 17
#: Weights are multiplied by this for each character, which changes no ratio and keeps sums in range.
SCALE = 1000.0


def _prefix_hashes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted prefix sums of code points, and the factor that makes a difference of two a hash of what lies between."""
    up, down = np.full(len(cp) + 1, BASE), np.full(len(cp) + 1, U64(pow(int(BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(len(cp) + 1, U64)
    np.cumsum((cp.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return sums, down


class Vocabulary:
    """Pieces by text, bytes by id, byte pieces, and a weight for every piece."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = {int(texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        bad = [t for t in (texts[i] for i in plain) if SPACE in t.lstrip(SPACE) or "\n" in t]
        if bad:
            raise ValueError(f"pieces cross words: {bad[:3]}")
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        weight = np.zeros(n)
        weight[order] = (np.arange(len(order)) + 10.0) ** -alpha
        for i in self.byte.values():
            weight[i] = (len(order) + 10.0) ** -alpha
        weight /= weight.sum()
        self.longest = max(len(texts[i]) for i in plain)
        if self.longest > 31:
            raise ValueError("a piece has more than 31 characters")
        self.weight = weight
        said = [texts[i].replace(SPACE, " ") for i in plain]
        size = np.fromiter(map(len, said), np.int64, len(said))
        first = np.cumsum(size) - size
        sums, inverse = _prefix_hashes(np.frombuffer("".join(said).encode("utf-32-le"), np.uint32))
        hashes = mix((sums[first + size] - sums[first]) * inverse[first])
        by = np.argsort(hashes)
        self.hashes, self.ids = hashes[by], np.array(plain)[by]
        self.bits = np.zeros(1 << BITS, bool)
        for k in range(1, self.longest + 1):
            s = first[size >= k]
            self.bits[mix((sums[s + k] - sums[s]) * inverse[s]) >> U64(64 - BITS)] = True

    def byte_ids(self, cp: int) -> list[int]:
        return [self.byte[x] for x in chr(cp).encode("utf-8", "surrogatepass")]

    def spelt(self, cp: np.ndarray) -> np.ndarray:
        """The weight of each character's byte pieces together."""
        known = {c: float(np.prod(self.weight[self.byte_ids(c)])) for c in np.unique(cp).tolist()}
        return np.array([known[c] for c in cp.tolist()])


class Lattices:
    """Filtered lattices of words, end to end. A word of n characters has n + 1 places; the ways into a place are
    neighbours in three arrays: cumulative chance, piece, and the place they come from."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.places, self.edges = 0, 0
        self.upto, self.piece = np.zeros(1 << 16), np.zeros(1 << 16, np.int32)
        self.back, self.way = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _room(self, names: tuple[str, ...], used: int, need: int) -> None:
        for name in names:
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

    def add(self, words: list[str]) -> None:
        """Filter new words forward, all of them one character at a time."""
        v = self.v
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(n) - n
        end = np.repeat(first + n, n)
        prefix, inverse = _prefix_hashes(cp)
        starts, lengths, piece, weight = [], [], [], []
        s = np.arange(len(cp))
        for k in range(1, v.longest + 1):
            s = s[s + k <= end[s]]
            h = mix((prefix[s + k] - prefix[s]) * inverse[s])
            begins = v.bits[h >> U64(64 - BITS)]  # only what begins some piece can grow into one
            s, h = s[begins], h[begins]
            at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
            hit = v.hashes[at] == h
            starts.append(s[hit])
            lengths.append(np.full(hit.sum(), k))
            piece.append(v.ids[at[hit]])
            weight.append(v.weight[v.ids[at[hit]]])
        # A character without a piece stands for its byte pieces, told apart by its code point above all ids.
        bare = np.ones(len(cp), bool)
        bare[starts[0]] = False
        bare = np.flatnonzero(bare)
        starts.append(bare)
        lengths.append(np.ones(len(bare), np.int64))
        piece.append(len(v.weight) + cp[bare].astype(np.int64))
        weight.append(v.spelt(cp[bare]))
        s, k, piece, weight = (np.concatenate(x) for x in (starts, lengths, piece, weight))
        word = np.repeat(np.arange(len(words)), n)[s]
        back, into = s + word, s + k + word  # a word's places lie one further for each word before it
        local = s + k - first[word]
        order = np.argsort((local << 44) | (into << 5) | k)
        back, into, piece, weight, k, local = (x[order] for x in (back, into, piece, weight, k, local))
        weight = weight * SCALE**k
        mass = np.zeros(len(cp) + len(words))
        mass[first + np.arange(len(words))] = 1.0
        upto = np.empty(len(into))
        bounds = np.searchsorted(local, np.arange(1, int(n.max()) + 2))
        for a, z in zip(bounds, bounds[1:], strict=False):
            if a == z:
                continue
            chance = mass[back[a:z]] * weight[a:z]
            new = np.flatnonzero(np.diff(into[a:z], prepend=-1))
            total = np.add.reduceat(chance, new)
            # Rare long words would leave the range of numbers: only ratios within reach of the longest piece count.
            off = (total < 1e-150) | (total > 1e150)
            upto[a:z] = chance / np.repeat(total, np.diff(np.append(new, z - a)))
            place = into[a:z][new]
            mass[place] = total
            if off.any():
                for p, t in zip(place[off], total[off], strict=True):
                    w = np.searchsorted(first + np.arange(len(words)), p, side="right") - 1
                    low = max(int(first[w] + w), int(p) - v.longest)
                    mass[low : p + 1] /= t
        order = np.argsort((into << 5) | k)
        e = self.edges + len(into)
        p = self.places + len(mass)
        self._room(("upto", "piece", "back"), self.edges, e)
        self._room(("way",), self.places, p)
        into, upto = into[order], upto[order]
        # Shares of a place add up from its own first way, so no other word moves their rounding.
        new = np.flatnonzero(np.diff(into, prepend=-1))
        size = np.diff(np.append(new, len(into)))
        for j in range(1, int(size.max())):
            new = new[size > j]
            size = size[size > j]
            upto[new + j] += upto[new + j - 1]
        self.upto[self.edges : e], self.piece[self.edges : e] = upto, piece[order]
        self.back[self.edges : e] = back[order] + self.places
        self.way[self.places : p] = self.edges + np.searchsorted(into, np.arange(len(mass)))
        last = np.flatnonzero(np.diff(into, append=-1))
        self.upto[self.edges + last] = 2.0  # the last way into a place takes what is left
        self.start.update(zip(words, (first + np.arange(len(words)) + self.places).tolist(), strict=True))
        self.edges, self.places = e, p

    def sample(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each word, drawn by its key: piece ids in order, and how many each word has."""
        if self.places > PLACES:
            self.clear()
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        unique, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        fresh = [w for w in unique if w not in self.start]
        if fresh:
            self.add(fresh)
        first = np.fromiter(map(self.start.__getitem__, unique), np.int64, len(unique))
        at = (first + np.fromiter(map(len, unique), np.int64, len(unique)))[code]
        first = first[code]
        live = np.argsort(first)  # equal words together: their places are read from near memory
        who, what, step = [], [], 0
        while len(live):
            u = (mix(keys[live] + U64((step * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> U64(11)).astype(np.float64) * 2.0**-53
            e = self.way[at[live]]
            more = np.flatnonzero(self.upto[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.upto[e[more]] <= u[more]]
            who.append(live)
            what.append(self.piece[e])
            at[live] = self.back[e]
            live = live[at[live] != first[live]]
            step += 1
        # The r-th draw of a word goes to its end less r.
        count = np.zeros(len(words), np.int64)
        turn = []
        for w in who:
            turn.append(count[w])
            count[w] += 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for w, x, r in zip(who, what, turn, strict=True):
            out[ends[w] - 1 - r] = x
        return self._spell(out, count)

    def _spell(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put byte pieces where an id stands for a character without a piece."""
        bare = np.flatnonzero(ids >= len(self.v.weight))
        if not len(bare):
            return ids.astype(np.int32), count
        spelt = [self.v.byte_ids(int(i) - len(self.v.weight)) for i in ids[bare]]
        size = np.ones(len(ids), np.int64)
        size[bare] = [len(x) for x in spelt]
        out = np.repeat(ids, size)
        at = (np.cumsum(size) - size)[bare]
        for a, x in zip(at.tolist(), spelt, strict=True):
            out[a : a + len(x)] = x
        total = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(count)])
        return out.astype(np.int32), total[edge[1:]] - total[edge[:-1]]


class Speller:
    """The bytes that each piece stands for, end to end, to turn ids back to text."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The texts that n[0], n[1], ... of the ids spell, each without the space put in front."""
        size = self.size[ids]
        at = np.cumsum(size) - size
        said = self.bytes[np.arange(int(size.sum())) - np.repeat(at - self.first[ids], size)]
        edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
        said = np.delete(said, edge[:-1][n > 0])
        off = edge - np.concatenate([[0], np.cumsum(n > 0)])
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(said)).cast(pa.string())


def _speller(path: str) -> Speller:
    cache = worker_cache()
    name = f"speller {path}"
    if name not in cache:
        cache[name] = Speller(path)
    return cache[name]


def _lattices(path: str, alpha: float) -> Lattices:
    cache = worker_cache()
    name = f"pieces {path} {alpha}"
    if name not in cache:
        cache[name] = Lattices(Vocabulary(path, alpha))
    return cache[name]


def encode_texts(lattices: Lattices, keys: list, texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and how many each text has."""
    words = [UNIT.findall(" " + t) if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.zeros(0, np.int32), n
    row = mix(np.array([k or 0 for k in keys], np.int64).astype(U64) + U64(seed))
    number = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(U64)
    draw = mix(np.repeat(row, n) + number)
    drawn = [lattices.sample(flat[a : a + WORDS], draw[a : a + WORDS]) for a in range(0, len(flat), WORDS)]
    ids, count = (np.concatenate(x) for x in zip(*drawn, strict=True))
    total = np.concatenate([[0], np.cumsum(count)])
    edge = np.concatenate([[0], np.cumsum(n)])
    return ids, total[edge[1:]] - total[edge[:-1]]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, alpha: float = 1.0, model: str = MODEL, text_out: bool = True,
           text_decoded: bool = False) -> DataFrame:
    """All columns of the documents (without `text_out` all but the text), and pieces (array of ids) and n_pieces.

    With `text_decoded` the text is the one decoded from the pieces, in the same worker; where it differs from the text
    encoded, the run fails. A null text stays null.
    """
    keep = [c for c in docs.columns if c not in ("pieces", "n_pieces")]
    rows = docs.select(*keep)
    key, text = keep.index(id_col), keep.index(text_col)
    out = [i for i in range(len(keep)) if text_out or i != text]
    schema = T.StructType([*(rows.schema[i] for i in out), T.StructField("pieces", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType())])

    def run(batches):
        lattices = _lattices(model, alpha)
        lattices.clear()  # what an earlier task left in this worker
        for b in pieces_of(batches, text, limit=1 << 20):
            ids, n = encode_texts(lattices, b.column(key).to_pylist(), b.column(text).to_pylist(), seed)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            cols = {i: b.column(i) for i in out}
            if text_decoded:
                said = _speller(model).texts(ids, n)
                if not said.equals(pc.fill_null(b.column(text), "")):
                    raise ValueError("pieces do not decode to the text")
                cols[text] = pc.if_else(pc.is_valid(b.column(text)), said, pa.scalar(None, said.type))
            yield pa.RecordBatch.from_arrays([*(cols[i] for i in out), lists, pa.array(n)], [*(keep[i] for i in out), "pieces", "n_pieces"])
        lattices.clear()

    return rows.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """All columns, and decoded: the text its pieces spell."""
    keep = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*keep)
    at = keep.index("pieces")

    def run(batches):
        speller = _speller(model)
        for b in pieces_of(batches, at, limit=1 << 18):
            lists = b.column(at)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            said = speller.texts(lists.flatten().to_numpy(), n)
            yield pa.RecordBatch.from_arrays([*b.columns, said], [*b.schema.names, "decoded"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, text_out=False))
    return out.select("doc_id", "n_pieces", F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("n_chars"))

"""Media columns in baseline JPEG: lossless payloads in coefficients, and DC-only thumbnails.

`encode_payload` stores bytes as the quantised coefficients of a grey baseline JPEG, 64 bytes to a block. A byte
b is the coefficient with size category 8 and amplitude bits b (b >= 128: b, else b - 255). The file's own Huffman
tables give (run 0, size 8) the code 0, and each block is a restart interval, so a block is 64 times 9 bits, 72
whole bytes, before byte stuffing. Quantisation is 1, so nothing is lost. A comment segment keeps the length.

`decode` reads any baseline JPEG (8 bits, Huffman, one scan): it parses the markers, Huffman-decodes the scan and
rebuilds the luminance thumbnail from DC coefficients alone, one pixel a block. Scans whose tables give one
length to every symbol in use, like those above, are unpacked in whole arrays; others symbol by symbol, by tables over the next 16
bits and a window of a few bytes, in time that grows with the scan.

Defined results: a null payload is empty (one block of zeros); equal payloads give equal files; ids may repeat or be
null; an empty table gives an empty result; other columns are not read. A file that is not baseline JPEG gives
nulls and the reason in `error`.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, table

#: Order of the coefficients of a block in the scan: (row, column) along anti-diagonals, direction alternating.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[(p[0] + p[1]) % 2 == 0]))])


def pad64(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def encode_payload(payload: bytes, used: int | None = None) -> bytes:
    """A grey baseline JPEG that holds the payload (a multiple of 64 bytes, `used` of them before padding);
    blocks of zeros fill the last row."""
    n = len(payload) // 64
    wide = min(math.isqrt(n - 1) + 1, 8191)
    high = -(-n // wide)
    if high > 8191:
        raise ValueError("the payload exceeds the largest JPEG")
    b = np.zeros((wide * high * 8, 8), np.uint16)
    b[: n * 8] = np.frombuffer(payload, np.uint8).reshape(-1, 8)
    bits = np.empty((len(b), 9), np.uint8)  # eight bytes, each after a zero bit, are nine bytes
    bits[:, 0] = b[:, 0] >> 1
    for k in range(1, 8):
        bits[:, k] = ((b[:, k - 1] << (8 - k)) | (b[:, k] >> (k + 1))) & 255
    bits[:, 8] = b[:, 7] & 255
    coded = np.empty((wide * high, 74), np.uint8)
    coded[:, :72] = bits.reshape(-1, 72)
    coded[:, 72] = 255
    coded[:, 73] = 0xD0 + np.arange(wide * high) % 8
    flat = coded.reshape(-1)[:-2]
    stuffed = np.flatnonzero(flat == 255)
    stuffed = stuffed[stuffed % 74 != 72]
    scan = np.insert(flat, stuffed + 1, 0) if len(stuffed) else flat
    one = lambda kind: _segment(0xC4, bytes([kind, 1, 1, *[0] * 14, 8, 0]))  # noqa: E731  code 0: size 8; code 10: end of block
    return b"".join((
        b"\xff\xd8", _segment(0xFE, b"payload %d %d" % (len(payload), len(payload) if used is None else used)), _segment(0xDB, bytes([0] + [1] * 64)),
        _segment(0xC0, bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        one(0x00), one(0x10), _segment(0xDD, b"\x00\x01"), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])), scan.tobytes(), b"\xff\xd9",
    ))


class Jpeg:
    """The parsed markers of a baseline JPEG."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.huff, self.comment, self.restart, at = {}, {}, b"", 0, 2
        self.parts: list[tuple[int, int, int, int]] = []
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 255:
                raise ValueError("a marker is missing")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("samples are not 8 bits")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a baseline frame")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                if not self.parts or body[0] != len(self.parts):
                    raise ValueError("not a single scan of a known frame")
                self.tables = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
                break
            elif marker == 0xD9:
                raise ValueError("no scan")
        self.scan = np.frombuffer(data, np.uint8, offset=at)

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            n = 64 * (wide + 1)
            self.quant[k] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            symbols = body[at + 17 : at + 17 + sum(counts)]
            codes, code, k = {}, 0, 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    if code >> length:
                        raise ValueError("a table has too many codes")
                    codes[(length, code)] = symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.huff[body[at]] = codes
            at += 17 + sum(counts)

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """The scan's bytes without markers and stuffing, and where each restart interval starts (and the end)."""
        s = self.scan
        ff = np.flatnonzero(s[:-1] == 255)
        follow = s[ff + 1]
        stop = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 255)]
        if not len(stop):
            raise ValueError("no end of image")
        keep = ff < stop[0]
        ff, follow = ff[keep], follow[keep]
        marks = ff[follow != 0]
        drop = np.ones(stop[0], bool)
        drop[ff[follow == 0] + 1] = False
        drop[marks] = False
        drop[marks + 1] = False
        before = np.concatenate([[0], np.cumsum(drop)])
        return s[: stop[0]][drop], np.concatenate([[0], before[marks], [before[-1]]])


def _fixed(jpeg: Jpeg) -> bool:
    """Whether every block is 64 symbols of code 0 and 8 amplitude bits: shown by tables and restart intervals."""
    return jpeg.restart == 1 and len(jpeg.parts) == 1 and all(jpeg.huff.get(k, {}).get((1, 0)) == 8 for k in (jpeg.tables[jpeg.parts[0][0]][0], 16 + jpeg.tables[jpeg.parts[0][0]][1]))


def _unpack(jpeg: Jpeg) -> np.ndarray | None:
    """Amplitude bytes, 64 a block in scan order, if all blocks have the fixed form; else None."""
    if not _fixed(jpeg):
        return None
    data, at = jpeg.intervals()
    if len(data) % 72 or not np.array_equal(at, np.arange(len(at)) * 72):
        return None
    g = data.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(g), 8), np.uint8)
    zero = np.zeros(len(g), np.uint16)
    for k in range(8):
        pair = (g[:, k] << 8) | g[:, k + 1]
        zero |= (pair >> (15 - k)) & 1
        out[:, k] = (pair >> (7 - k)) & 255
    return None if zero.any() else out.reshape(-1, 64)


def _lookup(codes: dict[tuple[int, int], int]) -> list[int]:
    """By the next 16 bits: 256 times the code's length, plus its symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int32)
    for (length, code), symbol in codes.items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table.tolist()


class _Bits:
    """The bits of one restart interval, and up to 32 ones after it, read through a window of a few bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n, self.left = data + b"\xff" * 8, 0, 0, 0, (len(data) + 4) * 8

    def peek(self, k: int) -> int:
        while self.n < k:
            self.held = self.held << 8 | self.data[self.at]
            self.at, self.n = self.at + 1, self.n + 8
        return self.held >> (self.n - k)

    def skip(self, k: int) -> None:
        if k > self.left:
            raise ValueError("the scan ends early")
        self.left, self.n = self.left - k, self.n - k
        self.held &= (1 << self.n) - 1

    def symbol(self, table: list[int]) -> int:
        entry = table[self.peek(16)]
        if not entry:
            raise ValueError("an unknown code")
        self.skip(entry >> 8)
        return entry & 255

    def value(self, k: int) -> int:
        """A number of size category k."""
        v = self.peek(k)
        self.skip(k)
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


def _walk(jpeg: Jpeg) -> tuple[dict[int, np.ndarray], list[list[int]]]:
    """Symbol by symbol: the DC coefficients of each component as a grid of blocks, and each block's coefficients."""
    data, at = jpeg.intervals()
    hmax, vmax = max(p[1] for p in jpeg.parts), max(p[2] for p in jpeg.parts)
    single = len(jpeg.parts) == 1
    size = lambda n, step: -(-n // step)
    mw, mh = (size(jpeg.width, 8), size(jpeg.height, 8)) if single else (size(jpeg.width, 8 * hmax), size(jpeg.height, 8 * vmax))
    grid = {c: np.zeros((mh * (1 if single else v), mw * (1 if single else h)), np.int32) for c, h, v, _ in jpeg.parts}
    blocks: list[list[int]] = []
    mcu, total = 0, mw * mh
    tables = {k: _lookup(codes) for k, codes in jpeg.huff.items()}
    for a, b in zip(at, at[1:], strict=False):
        bits, pred = _Bits(data[a:b].tobytes()), dict.fromkeys(grid, 0)
        for _ in range(min(jpeg.restart or total, total - mcu)):
            for c, h, v, _q in jpeg.parts:
                dc, ac = tables[jpeg.tables[c][0]], tables[16 + jpeg.tables[c][1]]
                for y in range(1 if single else v):
                    for x in range(1 if single else h):
                        block = [0] * 64
                        pred[c] += bits.value(bits.symbol(dc))
                        block[0], k = pred[c], 1
                        while k < 64:
                            s = bits.symbol(ac)
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                if k > 63:
                                    raise ValueError("a run leaves its block")
                                block[k] = bits.value(s & 15)
                            k += 1
                        row, col = divmod(mcu, mw)
                        grid[c][row * (1 if single else v) + y, col * (1 if single else h) + x] = block[0]
                        blocks.append(block)
            mcu += 1
    if mcu != total:
        raise ValueError("the scan ends early")
    return grid, blocks


def coefficients(values: np.ndarray) -> np.ndarray:
    """Signed coefficients of amplitude bytes of size category 8."""
    v = values.astype(np.int32)
    return np.where(v >= 128, v, v - 255)


def thumbnail(jpeg: Jpeg) -> np.ndarray:
    """Luminance of each block's mean, from DC coefficients alone."""
    first = jpeg.parts[0]
    values = _unpack(jpeg)
    if values is None:
        dc = _walk(jpeg)[0][first[0]]
    else:
        dc = coefficients(values[:, 0]).reshape(-(-jpeg.height // 8), -(-jpeg.width // 8))
    return np.clip(np.rint(dc * int(jpeg.quant[first[3]][0]) / 8 + 128), 0, 255).astype(np.uint8)


def payload(jpeg: Jpeg) -> bytes:
    """What encode_payload stored."""
    n = int(jpeg.comment.split()[1])
    values = _unpack(jpeg)
    if values is None:
        raise ValueError("no payload of this module")
    return values.tobytes()[:n]


def fingerprint(pixels: np.ndarray) -> str:
    """64-bit difference hash of a thumbnail: which of nine column means exceeds the next, in eight bands of rows."""
    h, w = pixels.shape
    rows = np.minimum(np.arange(9) * h // 8, h)
    cols = np.minimum(np.arange(10) * w // 9, w)
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    low, high = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    left, right = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    low, high, left, right = np.minimum(low, h - 1), np.minimum(high, h), np.minimum(left, w - 1), np.minimum(right, w)
    total = sums[np.ix_(high, right)] - sums[np.ix_(low, right)] - sums[np.ix_(high, left)] + sums[np.ix_(low, left)]
    mean = total / ((high - low)[:, None] * (right - left)[None, :])
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def _encode(batches):
    for b in pieces_of(batches, 1):
        files = [encode_payload(pad64(t), len(t)) for t in (t or b"" for t in b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each row's text, as UTF-8 padded to 64 bytes, in a JPEG."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(
        _encode, "doc_id long, media binary"
    )


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "width int, height int, thumbnail_sha256 string, feature string, error string"
)


def _decode(batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for b in batches:
        rows = []
        for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = data or b""
            row = [key, None, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None, None, None, None]
            try:
                jpeg = Jpeg(data)
                small = thumbnail(jpeg)
                if jpeg.comment.startswith(b"payload "):
                    held = payload(jpeg)
                    row[1:5] = int(jpeg.comment.split()[2]), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:])
                row[7:11] = jpeg.width, jpeg.height, hashlib.sha256(small.tobytes()).hexdigest(), f"{jpeg.width}x{jpeg.height}:{fingerprint(small)}"
            except (ValueError, IndexError, KeyError) as e:
                row[11] = str(e) or "broken"
            rows.append(row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def features(media: DataFrame) -> DataFrame:
    """Markers, dimensions, thumbnail hashes and any payload of a column of JPEG files."""
    return media.select("doc_id", "media").mapInArrow(_decode, FEATURES)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(encode(table(spark, sf_dir, "documents")))

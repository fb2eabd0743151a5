"""Numpy text helpers shared by the Python-side operators.

A text is handled as UTF-8 bytes. Translation tables keep every byte in its
place, so a byte offset found in a normalised text is an offset of the original.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_LOWER = {c: c + 32 for c in range(65, 91)}
#: A-Z lower-cased; \t \n \v \f \r become a space; everything else stays.
SPACE_WORDS = bytes(32 if 9 <= c <= 13 else _LOWER.get(c, c) for c in range(256))
#: A-Z lower-cased; every other ASCII byte that is no digit or letter becomes a space.
ALNUM_WORDS = bytes(
    _LOWER.get(c, c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32
    for c in range(256))

_P = np.uint64(0x9E3779B97F4A7C15)          # odd: has an inverse modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 17                             # bytes hashed at once


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_BLOCK * 2, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW, _INV = _powers(_P), _powers(_P_INV)


_HELD: dict[str, object] = {}


def held(key: str, make):
    """A worker's large model, made once. Workers live on from stage to stage, so
    they hold one at a time: asking for another drops it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def small_batches(spark: SparkSession) -> None:
    """Texts run from a word to megabytes: where the session does not say otherwise,
    keep the batches that go to Python small."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text, without decoding them."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def split_words(text: bytes | None, table: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words joined by one space, start of each word in it, end of each)."""
    words = (text or b"").translate(table).split()
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    return b" ".join(words), ends - size, ends


def word_starts(text: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of each word in the original text."""
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = np.frombuffer(text.translate(table), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def code_points(text: bytes, offsets: np.ndarray) -> np.ndarray:
    """Code point offsets of byte offsets."""
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))[offsets]


def ngram_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` words, all runs in order.

    A polynomial prefix sum over the bytes gives every run's hash from two
    positions. Texts are hashed block by block, so scratch memory is bounded.
    """
    count = len(starts) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    first, last = starts[:count], ends[n - 1:]
    out = np.empty(count, dtype=np.uint64)
    raw = np.frombuffer(joined, dtype=np.uint8)
    at = 0
    with np.errstate(over="ignore"):
        while at < count:
            base = int(first[at])
            to = max(at + 1, int(np.searchsorted(last, base + len(_POW) - 1, side="right")))
            to = min(to, count)
            width = int(last[to - 1]) - base
            if width >= len(_POW):           # one run longer than a block (giant words)
                out[at] = _long_hash(raw[base:base + width])
                at += 1
                continue
            piece = raw[base:base + width].astype(np.uint64)
            piece += np.uint64(1)
            piece *= _POW[:width]
            prefix = np.zeros(width + 1, dtype=np.uint64)
            np.cumsum(piece, out=prefix[1:])
            s, e = first[at:to] - base, last[at:to] - base
            out[at:to] = (prefix[e] - prefix[s]) * _INV[s] + (e - s).astype(np.uint64)
            at = to
    return mix(out)


def _long_hash(raw: np.ndarray) -> np.uint64:
    """The same polynomial hash, for a run of any length."""
    total, shift = 0, 1
    for i in range(0, len(raw), _BLOCK):
        piece = raw[i:i + _BLOCK].astype(np.uint64) + np.uint64(1)
        part = int((piece * _POW[:len(piece)]).sum(dtype=np.uint64))
        total = (total + part * shift) % (1 << 64)
        shift = shift * pow(int(_P), len(piece), 1 << 64) % (1 << 64)
    return np.uint64((total + len(raw)) % (1 << 64))

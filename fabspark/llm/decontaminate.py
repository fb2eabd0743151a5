"""Benchmark decontamination with an Aho-Corasick automaton over item windows.

Benchmark texts are normalised (A-Z lower-cased, every run of other ASCII
characters than letters and digits is a break) and cut into windows of
``window`` consecutive words; a shorter item is one window. Any such window of
an item holds a whole one of the item's blocks, cut from its start, of half a
window each. One automaton over the blocks (and over shorter items as they are)
scans each normalised document once; an occurrence is extended to both sides as
long as the words agree with the item, and counts if it reaches a window. Word
offsets are mapped back to code points of the original text.

The automaton is sent to every worker, so its size is bounded: items are cut into
overlapping pieces of at most ``PIECE_WORDS`` words, repeats are removed, and at
most about ``max_item_bytes`` of pieces make one automaton (some 50 bytes of a
worker's memory a byte). A larger benchmark is dealt by piece to several automata,
which scan in stages of their own, so that a worker holds one at a time (same
result; the documents and what was found are written between two stages).

Defined cases: a null or empty text has no words and no hit; a null or empty
item has no window; a null item_id still hits but is not listed; items repeated
under the same id count once; texts and items of any length are scanned whole;
an input column named like a result column is replaced; empty tables work.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .textkit import ALNUM_WORDS, code_points, held, small_batches, texts_as_bytes, word_starts

RESULT = ("n_words", "n_hit", "items", "spans", "_ranges", "_items")
PIECE_WORDS = 2000


def item_pieces(text: bytes | None, window: int) -> list[bytes]:
    """Distinct pieces of a normalised item that hold every window of it, each at most PIECE_WORDS words (or a window) long."""
    words = (text or b"").translate(ALNUM_WORDS).split()
    size = max(window, PIECE_WORDS)
    starts = range(0, max(1, len(words) - window + 1), size - window + 1)
    return list(dict.fromkeys(b" ".join(words[i:i + size]) for i in starts)) if words else []


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), texts_as_bytes(b.column("text"))):
                found = item_pieces(text, window)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())],
                                                     names=["item_id", "piece"])
    return run


class _Machine:
    """The automaton over the blocks of some pieces, and the pieces' words."""

    def __init__(self, rows: list[tuple], window: int):
        self.window, half = window, (window + 1) // 2
        same: dict[bytes, set[str]] = {}                          # pieces of equal words are one
        for item, piece in rows:
            same.setdefault(piece, set()).update(() if item is None else (item,))
        word: dict[bytes, bytes] = {}
        self.pieces = [([word.setdefault(w, w) for w in piece.split(b" ")], sorted(ids)) for piece, ids in same.items()]
        blocks: dict[str, list[tuple[int, int]]] = {}
        for n, (words, _) in enumerate(self.pieces):
            size = half if len(words) >= window else len(words)
            for i in range(0, len(words) - size + 1, size):
                blocks.setdefault(f" {b' '.join(words[i:i + size]).decode('latin-1')} ", []).append((n, i))
        self.found = ahocorasick.Automaton() if blocks else None
        if blocks:
            for block, places in blocks.items():
                self.found.add_word(block, (len(block), tuple(places)))
            self.found.make_automaton()

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, end, item ids) of every longest run of words that holds a window."""
        if self.found is None or not words:
            return
        starts, done = None, {}                                   # done: end of the last run by piece and distance
        for end, (length, places) in self.found.iter(f" {b' '.join(words).decode('latin-1')} "):
            if starts is None:
                size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                starts = np.cumsum(size + 1) - size - 1
            at = int(np.searchsorted(starts, end - length + 1))
            for n, i in places:
                if done.get((n, at - i), -1) > at:
                    continue
                mine, ids = self.pieces[n]
                first, last = at, at
                while first > 0 and first - at + i > 0 and words[first - 1] == mine[first - 1 - at + i]:
                    first -= 1
                while last < len(words) and last - at + i < len(mine) and words[last] == mine[last - at + i]:
                    last += 1
                done[n, at - i] = last
                if last - first >= min(self.window, len(mine)):
                    yield first, last, ids


def _scan(shared, window: int, passed: list[str]):
    """Adds to `_ranges` (flat word ranges) and `_items` what this automaton finds."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held(f"automaton {key}", lambda: _Machine(shared.value, window))
        for b in batches:
            n_words, ranges, items = [], [], []
            before = (b.column("_ranges").to_pylist(), b.column("_items").to_pylist())
            for text, old, seen in zip(texts_as_bytes(b.column("text")), *before):
                words = (text or b"").translate(ALNUM_WORDS).split()
                spans, ids = list(old), set(seen)
                for start, end, owners in machine.scan(words):
                    spans += (start, end)
                    ids.update(owners)
                n_words.append(len(words))
                ranges.append(spans)
                items.append(sorted(ids))
            cols = [b.column(c) for c in passed]
            cols += [pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.int64())),
                     pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*passed, "n_words", "_ranges", "_items"])
    return run


def _finish(passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, spans = [], []
            for i, flat in enumerate(b.column("_ranges").to_pylist()):
                merged: list[list[int]] = []
                for s, e in sorted(zip(flat[0::2], flat[1::2])):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                n_hit.append(sum(e - s for s, e in merged))
                found: list[dict] = []
                if merged:
                    text = b.column("text")[i].as_py().encode()
                    first, last = word_starts(text, ALNUM_WORDS)
                    at = np.array(merged)
                    ends = zip(code_points(text, first[at[:, 0]]).tolist(),
                               code_points(text, last[at[:, 1] - 1]).tolist())
                    found = [{"start": s, "end": e} for s, e in ends]
                spans.append(found)
            cols = [b.column(c) for c in passed]
            cols += [b.column("n_words"), pa.array(n_hit, pa.int64()), b.column("_items"),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, names=[*passed, "n_words", "n_hit", "items", "spans"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10,
               max_item_bytes: int = 2_000_000) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence of a window),
    items (ids with occurring windows, sorted) and spans (code points, merged)."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULT])
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = items.mapInArrow(_pieces(window), "item_id string, piece binary").distinct()
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    parts = max(1, -(-size // max_item_bytes))
    if parts > 1:
        pieces = cut_lineage(pieces)                    # read once a part
    passed = docs.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumns({"_ranges": F.array().cast("array<bigint>"), "_items": F.array().cast("array<string>")})
    finish = _finish(passed)
    for k in range(parts):
        part = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(parts)) == k)
        rows = [(r["item_id"], bytes(r["piece"])) for r in part.collect()]
        scan = _scan(spark.sparkContext.broadcast(rows), window, passed)
        if k + 1 < parts:
            out = cut_lineage(out.mapInArrow(
                scan, f"{kept}, n_words bigint, _ranges array<bigint>, _items array<string>").drop("n_words"))
    # the last scan also finishes its rows: a step of its own would need another worker a core
    return out.mapInArrow(lambda batches: finish(scan(batches)), f"{kept}, n_words bigint, n_hit bigint, "
                          "items array<string>, spans array<struct<start: bigint, end: bigint>>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark window; columns unchanged, whatever their names."""
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    found = find_leaks(plain, benchmark, window).where("n_hit = 0")
    return found.select(*[F.col(a).alias(b) for a, b in zip(plain.columns, docs.columns)])

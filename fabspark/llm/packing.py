"""Best-fit packing of tokenised documents into fixed-capacity sequences.

Only a piece's length matters for packing, and there are at most ``capacity``
lengths. So the plan is made from a histogram of lengths (at most ``capacity``
rows on the driver, whatever the corpus): pieces above one third of the
capacity are matched greedily, at most two to a sequence; smaller ones fill the
remaining gaps best-fit, longest first. The plan is a list of runs "pieces
number r.. of length L go to sequences b.., k each, at offset o"; every piece
finds its place from its number among the pieces of its length, which comes from
per-partition counts. No task holds more than a stream of its own rows.

Defined cases: a null or empty text is one piece holding the end id only;
repeated rows (and equal doc_ids) are packed each; an empty table gives no rows;
extra columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .bpe import encoder
from .textkit import small_batches

PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "_part int, _nth bigint")
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]] if n else []


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row a piece, with its number among this partition's pieces of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        counts = [0] * (capacity + 1)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = memoryview(enc.ids(text.as_py()) + end)
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]),
                                 part, counts[length]))
                    counts[length] += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"])
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Plan:
    """Runs of equal pieces and the number of sequences, from a length histogram."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: int(c) for s, c in histogram.items() if c}
        self.used = {s: 0 for s in self.left}          # pieces of a length already placed
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []   # length, first, n, per, base, offset
        self.gaps: dict[int, list[tuple[int, int]]] = {}            # gap -> [(base, sequences)]
        self._match_large()
        self._fill_small()

    def _place(self, size: int, n: int, per: int, base: int, offset: int) -> None:
        self.runs.append((size, self.used[size], n, per, base, offset))
        self.used[size] += n
        self.left[size] -= n

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _gap(self, gap: int, base: int, n: int) -> None:
        if gap and n:
            self.gaps.setdefault(gap, []).append((base, n))

    def _match_large(self) -> None:
        """The largest piece takes the largest partner that still fits: a maximum
        matching, as whatever fits a larger piece fits a smaller one too."""
        large = sorted((s for s in self.left if 3 * s > self.capacity), reverse=True)
        for size in large:
            while self.left[size]:
                mate = next((t for t in large if t <= min(size, self.capacity - size) and self.left[t]
                             and (t != size or self.left[t] > 1)), None)
                if mate is None:
                    n = self.left[size]
                    base = self._open(n)
                    self._place(size, n, 1, base, 0)
                    self._gap(self.capacity - size, base, n)
                elif mate == size:
                    n = self.left[size] // 2
                    base = self._open(n)
                    self._place(size, 2 * n, 2, base, 0)
                    self._gap(self.capacity - 2 * size, base, n)
                else:
                    n = min(self.left[size], self.left[mate])
                    base = self._open(n)
                    self._place(size, n, 1, base, 0)
                    self._place(mate, n, 1, base, size)
                    self._gap(self.capacity - size - mate, base, n)

    def _fill_small(self) -> None:
        for size in sorted((s for s in self.left if 3 * s <= self.capacity), reverse=True):
            while self.left[size]:
                gap = min((g for g, held in self.gaps.items() if g >= size and held), default=None)
                if gap is None:
                    gap, per = self.capacity, self.capacity // size
                    n = -(-self.left[size] // per)
                    base = self._open(n)
                else:
                    base, n = self.gaps[gap].pop()
                    per = gap // size
                # one sequence takes as many as fit before the next is the best fit
                full = min(n, self.left[size] // per)
                if full:
                    self._place(size, full * per, per, base, self.capacity - gap)
                    self._gap(gap - per * size, base, full)
                rest = self.left[size] if full < n and self.left[size] < per else 0
                if rest:
                    self._place(size, rest, per, base + full, self.capacity - gap)
                    self._gap(gap - rest * size, base + full, 1)
                    full += 1
                self._gap(gap, base + full, n - full)


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Sequence and offset of each piece from its global number of its length."""
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    sizes, firsts = runs[:, 0], runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = (np.asarray(b.column(c), dtype=np.int64) for c in ("length", "_number"))
            lo, hi = np.searchsorted(sizes, length, "left"), np.searchsorted(sizes, length, "right")
            at = np.empty(len(length), dtype=np.int64)
            for size in np.unique(length):             # at most `capacity` lengths
                mine = length == size
                a, z = lo[mine][0], hi[mine][0]
                at[mine] = a + np.searchsorted(firsts[a:z], nth[mine], "right") - 1
            i = nth - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(runs[at, 4] + i // runs[at, 3]), pa.array(runs[at, 5] + i % runs[at, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return pieces.mapInArrow(run, PLACED)


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    small_batches(docs.sparkSession)
    pieces = cut_lineage(tokenise(docs, tokenizer, end_id, capacity))   # encoded once
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = (pieces.join(before, ["_part", "length"])
                      .withColumn("_number", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before"))
    return place(numbered, Plan(histogram, capacity))

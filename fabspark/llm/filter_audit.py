"""What a chain of filters removes, for every order of the filters, from sorted posting lists.

Every document is judged once by all filters. Rows are dealt into ranges of ids;
inside a range each part (language) has one sorted list of failing ids per filter,
and lists of good and of toxic ids. Unions of lists come from k-way merges
that gallop (ids of the shorter list are looked up in the longer one), differences
alike. The sizes of (filter, filters before it) add up over the ranges: 80 numbers a
part, from which every step of the 120 orders is read.

Filters fail a document: A under 200 words; B distinct words under half of the words; C over
3 % of the code points are A-Z; D a character of ``#$%&*|``; E its text equals that of a
smaller doc_id anywhere in the table. Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.

Defined cases: a null text is empty (and equal to empty texts); a null part is the empty string; a row
with null doc_id never fails E nor makes another fail, and has no labels; repeated rows are
rows of their own and never fail E by each other (equal ids); a document is good (toxic) if any of its
label rows says 1; very long texts are read whole; equal texts are found by a 128-bit digest; an
empty table has no parts and gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .hot_join import attach, hot_keys
from .textkit import small_batches, texts_as_bytes

FILTERS = "ABCDE"
RANGE_ROWS = 1 << 16                 # ids of one range
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))    # UTF-8 bytes that do not start a code point
_MARKS = b"#$%&*|"


def failing(text: bytes) -> int:
    """Bits of the filters A to D that fail the text."""
    words = text.translate(_SPACES).split(b" ")
    distinct = set(words)
    blank = words.count(b"")
    n, different = len(words) - blank, len(distinct) - (blank > 0)
    points = len(text.translate(None, _INNER))
    upper = len(text) - len(text.translate(None, _UPPER))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return (n < 200) | (100 * different < 50 * n) << 1 | (100 * upper > 3 * points) << 2 | marked << 3


def judge(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text, bits of the failing filters A to D."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in texts_as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                 pa.array([failing(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "fails"])
    cols = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return cols.mapInArrow(run, "doc_id bigint, part string, digest binary, fails int")


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge of two sorted lists without repeats."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    new = ~_found(a, b, at)
    return np.insert(a, at[new], b[new])


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted ids of ``a`` that are not in ``b``."""
    if len(a) <= len(b):
        return a[~_found(b, a, np.searchsorted(b, a))]
    at = np.searchsorted(a, b)
    return np.delete(a, at[_found(a, b, at)])


def _found(a: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return a[np.minimum(at, len(a) - 1)] == ids if len(a) else np.zeros(len(ids), dtype=bool)


def range_sizes(lists: Sequence[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, ...]]:
    """(filter, set before it, union before, removed, redundant, good lost, toxic lost) of one range and part."""
    unions = [np.empty(0, dtype=np.int64)]
    for s in range(1, 1 << len(lists)):                        # one more list merged into a smaller union
        low = (s & -s).bit_length() - 1
        unions.append(union(unions[s & (s - 1)], lists[low]))
    for f, mine in enumerate(lists):
        for s, before in enumerate(unions):
            if s >> f & 1:
                continue
            removed = minus(mine, before)
            yield (f, s, len(before), len(removed), len(mine) - len(removed),
                   len(removed) - len(minus(removed, good)), len(removed) - len(minus(removed, toxic)))


_SIZES = ["n", "before", "removed", "redundant", "good_lost", "toxic_lost"]


def _range_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of id, to the sizes of each range and part."""
    def sums(table: pa.Table) -> pa.RecordBatch:
        codes = table.column("part").combine_chunks().dictionary_encode()
        part = np.asarray(codes.indices)
        fails, good, toxic = (np.asarray(table.column(c)) for c in ("fails", "good", "toxic"))
        order = np.argsort(part, kind="stable")                # the ids of a part stay in order
        out: list[tuple] = []
        for ids in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            lists = [ids[fails[ids] >> f & 1 == 1] for f in range(len(FILTERS))]
            name = codes.dictionary[int(part[ids[0]])].as_py()
            out += [(name, f, s, len(ids), *sizes) for f, s, *sizes in range_sizes(lists, ids[good[ids]], ids[toxic[ids]])]
        kinds = [pa.string(), *[pa.int64()] * 8]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "filter", "set", *_SIZES])

    held, rows = [], 0
    for b in batches:
        while b.num_rows:
            take = min(b.num_rows, RANGE_ROWS - rows)
            held.append(b.slice(0, take))
            b, rows = b.slice(take), rows + take
            if rows == RANGE_ROWS:
                yield sums(pa.Table.from_batches(held))
                held, rows = [], 0
    if rows:
        yield sums(pa.Table.from_batches(held))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    small_batches(spark)
    judged = cut_lineage(judge(docs, part))
    # E: the smallest id of each repeated text, met by the rows of that text
    texts = cut_lineage(judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    met = attach(judged, texts.drop("rows"), "digest", hot_keys(texts, "digest", "rows"), "left")
    fails = F.col("fails") + F.when(F.col("doc_id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))
    marked = cut_lineage(met.select("doc_id", "part", fails.alias("fails")))
    # labels, by id
    ids = cut_lineage(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = attach(marked, said, "doc_id", hot_keys(ids, "doc_id", "rows"), "left")
    rows = cut_lineage(rows.select("doc_id", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"),
                                   F.coalesce("toxic", F.lit(False)).alias("toxic"), F.monotonically_increasing_id().alias("row")))
    ranges = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("doc_id", "row")
    sums = ranges.mapInArrow(_range_sums, "part string, filter bigint, set bigint, " + ", ".join(f"{c} bigint" for c in _SIZES))
    sums = cut_lineage(sums.groupBy("part", "filter", "set").agg(*[F.sum(c).alias(c) for c in _SIZES]))
    return _every_order(sums)


def _every_order(sums: DataFrame) -> DataFrame:
    """Sizes by (part, filter, set before) to all steps of all orders."""
    k = len(FILTERS)
    steps = [("".join(order), i + 1, FILTERS.index(order[i]), reduce(lambda s, c: s | 1 << FILTERS.index(c), order[:i], 0))
             for order in permutations(FILTERS) for i in range(k)]
    steps = sums.sparkSession.createDataFrame(steps, "filter_order string, step int, filter bigint, set bigint")   # 600 rows
    # a set of m filters comes before a filter in m! (k - 1 - m)! orders
    orders = F.lit(None).cast("long")
    for m in range(k):
        orders = F.when(F.bit_count("set") == m, F.lit(math.factorial(m) * math.factorial(k - 1 - m)).cast("long")).otherwise(orders)
    alone = F.expr(f"`set` = {(1 << k) - 1} - shiftleft(1L, cast(filter AS int))")
    by_filter = sums.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders).alias("shapley"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"))
    return (sums.join(F.broadcast(steps), ["filter", "set"]).join(by_filter, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("before") - F.col("removed")).alias("kept"), "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley"))

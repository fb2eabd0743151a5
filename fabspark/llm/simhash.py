"""SimHash near-duplicates by deletion-variant signatures, and their connected components.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two
fingerprints link at ``bits`` or fewer differing bits. They are cut into ``bits // 2 + 1`` segments:
if every segment differed by two bits or more, that would be more than ``bits``, so one segment
differs by one bit at most. Each fingerprint is indexed under all variants of its segments
with one bit wiped out (64 keys); linked fingerprints agree on one of these keys, and
those that meet are compared exactly.

Equal fingerprints are one node from the start. The index is sorted by range, so a hot key is
dealt over several tasks by fingerprint. A key with more than ``bucket`` fingerprints is not compared pair
by pair: its fingerprints link exactly where the balls of radius ``bits / 2`` around them
share a point, so points take the place of pairs, and the cost stays linear. Of each
bucket only the edges of a spanning forest are emitted.

Defined cases: null and wordless texts have fingerprint zero and link like any other; fewer words than
``n`` make one shingle; repeated rows are rows of their own with one component; rows with a null doc_id take the component of
their text, null if it holds no id; very long texts are hashed whole, in blocks; a bit on exactly half the shingles is 0;
empty tables give no rows; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .components import components
from .hot_join import attach, hot_keys
from .textkit import SPACE_WORDS, small_batches, split_words, texts_as_bytes

SEED = 42
BUCKET = 16_384                       # a ball of radius two has 2081 points, a point costs about eight compares
_BLOCK = 1 << 15                      # shingles hashed at once


def fingerprint(text: bytes | None, n: int = 4) -> int:
    joined, starts, ends = split_words(text, SPACE_WORDS)
    if not len(starts):
        return 0
    n = min(n, len(starts))
    first, last = starts[:len(starts) - n + 1].tolist(), ends[n - 1:].tolist()
    view, set_bits, digest = memoryview(joined), np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), _BLOCK):
        part = [digest(view[s:e], SEED) for s, e in zip(first[at:at + _BLOCK], last[at:at + _BLOCK])]
        raw = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    major = 2 * set_bits > len(first)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, n) for t in texts_as_bytes(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return docs.mapInArrow(run, "doc_id bigint, fp bigint")


@lru_cache
def variants(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 64 one-bit deletions: the mask of the rest of its segment, the shift, the tag."""
    cuts = np.linspace(0, 64, bits // 2 + 2).astype(int).tolist()
    rows = [(((1 << hi) - (1 << lo)) & ~(1 << bit), lo) for lo, hi in zip(cuts, cuts[1:]) for bit in range(lo, hi)]
    tag = np.arange(64, dtype=np.uint64) << np.uint64(max(np.diff(cuts)))
    return np.array([m for m, _ in rows], dtype=np.uint64), np.array([s for _, s in rows], dtype=np.uint64), tag


def _signatures(bits: int):
    """Fingerprints to (key, fp), one row a deletion variant. Needs segments of at most 57 bits: two of them or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, shifts, tags = variants(bits)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fps = np.asarray(b.column("fp"))[at:at + 4096]
                keys = ((fps.view(np.uint64)[:, None] & masks) >> shifts) + tags
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, 64))], names=["key", "fp"])
    return run


class Forest:
    """Union-find over row numbers, on arrays of edges. The root is the smallest row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while True:
            higher = self.up[at]
            if (higher == at).all():
                self.up[rows] = at
                return at
            at = higher

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _link_groups(key: np.ndarray, fp: np.ndarray, bits: int) -> Forest:
    """Rows in order of key, linked with rows of the same key that are near. Compares row i with i + 1, i + 2, ..."""
    forest, n, d = Forest(len(key)), len(key), 1
    at = np.flatnonzero(key[1:] == key[:-1])
    while len(at):
        near = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= bits]
        if len(near):
            forest.link(near, near + d)
        d += 1
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
    return forest


def _compare(bits: int, bucket: int, whole_keys: bool):
    """Rows (key, fp) in order of both to edges (a, b); to (key, a) of keys that may go on in another task
    (the first and the last one, unless ``whole_keys``); to (a) of fingerprints of keys above ``bucket``; and to
    (key) of keys above it that may go on in another task."""
    def rows(key=None, a=None, b=None) -> pa.RecordBatch:
        size = len(key if a is None else a)
        column = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(x)
        return pa.RecordBatch.from_arrays([column(key), column(a), column(b)], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        opened = True                       # the first key in hand is the first one of the task
        above = None                        # the key in progress that is above the bucket

        def settle(key, fp, opened, closing):
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(edge, len(key)))
            large = np.repeat(size > bucket, size)
            out = [rows(a=fp[large])]
            if not whole_keys:
                loose = (key == key[0]) & opened | (key == key[-1]) & closing
                out.append(rows(key=np.unique(key[loose & large])))
                loose &= ~large
                out.append(rows(key=key[loose], a=fp[loose]))
                large |= loose
            key, fp = key[~large], fp[~large]
            forest = _link_groups(key, fp, bits)
            roots = forest.root(np.arange(len(key)))
            at = np.flatnonzero(roots != np.arange(len(key)))
            pairs = np.unique(np.stack([fp[at], fp[roots[at]]], axis=1), axis=0)
            return [*out, rows(a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]))]

        for batch in batches:
            k, f = np.asarray(batch.column("key")), np.asarray(batch.column("fp"))
            if above is not None:
                more = int(np.searchsorted(k, above, side="right"))
                yield rows(a=f[:more])
                k, f = k[more:], f[more:]
            if not len(k):
                continue
            above = None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            last = int(np.searchsorted(key, key[-1]))          # the last key may go on in the next batch
            if last > 0 and len(key) >= 1 << 16:
                yield from settle(key[:last], fp[:last], opened, False)
                key, fp, opened = key[last:], fp[last:], False
            elif last == 0 and len(key) > bucket:
                yield rows(a=fp)
                if not whole_keys:
                    yield rows(key=key[:1])
                above, opened = key[0], False
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from settle(key, fp, opened, True)
    return run


def _ball(radius: int) -> np.ndarray:
    """Differences to all points at most ``radius`` bits away."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)], dtype=np.uint64)


def _points(bits: int, edges: bool):
    """Fingerprints to (point, fp): the points of their balls, each once a chunk, with the root of those it links;
    or, with ``edges``, to these links (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        away = _ball(bits // 2)
        chunk = max(1, (1 << 21) // len(away))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                fps = np.sort(np.asarray(batch.column("fp"))[at:at + chunk])
                points = (fps.view(np.uint64)[:, None] ^ away).ravel()
                order = np.argsort(points, kind="stable")
                points, owner = points[order], order // len(away)
                forest, same = Forest(len(fps)), points[1:] == points[:-1]
                forest.link(owner[1:][same], owner[:-1][same])
                roots = forest.root(np.arange(len(fps)))
                if edges:
                    a = np.flatnonzero(roots != np.arange(len(fps)))
                    yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[roots[a]])], names=["a", "b"])
                else:
                    first = np.concatenate(([True], ~same))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(points[first].view(np.int64)), pa.array(fps[roots[owner[first]]])], names=["point", "fp"])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (point, fp) in order to edges between neighbours of one point."""
    point = fp = None
    for b in batches:
        p, f = np.asarray(b.column("point")), np.asarray(b.column("fp"))
        if not len(p):
            continue
        if point is not None:
            p, f = np.concatenate([[point], p]), np.concatenate([[fp], f])
        point, fp = p[-1], f[-1]
        at = np.flatnonzero((p[1:] == p[:-1]) & (f[1:] != f[:-1]))
        pairs = np.unique(np.stack([f[at], f[at + 1]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])


def links(nodes: DataFrame, bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that join all linked ones, directly or by others."""
    if not 2 <= bits <= 8 or bits % 2:
        raise ValueError(f"bits must be 2, 4, 6 or 8, not {bits}")
    out, pair = "key bigint, a bigint, b bigint", "a bigint, b bigint"
    index = nodes.select("fp").mapInArrow(_signatures(bits), "key bigint, fp bigint")
    met = cut_lineage(index.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp").mapInArrow(_compare(bits, bucket, False), out))
    # keys that lie across a border between tasks, a few groups a task; some are above the bucket elsewhere
    loose, above = met.where("key IS NOT NULL AND a IS NOT NULL"), met.where("key IS NOT NULL AND a IS NULL").select("key").distinct()
    few = loose.join(above, "key", "left_anti").select("key", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key", "fp")
    rest = cut_lineage(few.mapInArrow(_compare(bits, bucket, True), out).union(
        loose.join(above, "key", "left_semi").select(F.lit(None).cast("long"), "a", "b")))
    both = met.where("key IS NULL").union(rest)
    hot = cut_lineage(both.where("b IS NULL").select(F.col("a").alias("fp")).distinct())
    points = hot.mapInArrow(_points(bits, False), "point bigint, fp bigint").repartition("point").sortWithinPartitions("point", "fp")
    return (both.where("b IS NOT NULL").select("a", "b").union(hot.mapInArrow(_points(bits, True), pair))
            .union(points.mapInArrow(_meet, pair)).distinct())


def near_duplicates(docs: DataFrame, n: int = 4, bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    small_batches(docs.sparkSession)
    rows = cut_lineage(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), n))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")))
    label = components(links(nodes, bits, bucket)).withColumnRenamed("node", "fp")
    named = cut_lineage(nodes.join(label, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut_lineage(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    known = cut_lineage(attach(named.select("root", "fp"), least.select("root", "component_id"), "root",
                               hot_keys(least, "root", "members")).select("fp", "component_id"))
    done = attach(rows, known, "fp", hot_keys(nodes, "fp", "rows"))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Exact n-gram Jaccard join, split by set size, and its connected components.

A text's set holds the hashes of its distinct word n-grams. Two sets link when
100 * |A & B| >= percent * |A | B|, which means an overlap of at least
o(a, b) = ceil(p (a + b) / (p + 100)) and at most H(a, b) = a + b - 2 o elements
in only one of them.

* Small sets enumerate fixed-size subsets: linked sets share a subset of o(a, b)
  elements, so each emits all its subsets of the sizes its partners can ask for.
* Large sets are found by inverted lists. Lists of single n-grams would be hot
  (passages shared by many documents), so a list holds the sets that agree on a
  whole *part*: the hash space is cut into k > H parts, linked sets agree on at
  least k - H of them, and a set is listed under its largest parts, as many as
  make sure that one agreeing part is listed by both.

A set takes the way that costs it less (subsets against list entries, one entry
counting ``SCAN_COST``); sets near the boundary are listed as well.

Equal sets are one node from the start. Nodes that meet in a list are clustered
(any link lies within a cluster), each cluster's texts are gathered once (they take
less room than their n-grams), and the overlaps are computed exactly there. List keys
go straight to their shuffle and are not kept; shuffles go as soon as they are read. A cluster with more n-grams than
``cluster_grams`` is cut into blocks and compared block against block.

Defined cases: null or wordless texts have no set, 0 n-grams, and link with
nothing (component: their own id); fewer words than n make one n-gram; rows
repeated under one doc_id are separate rows, each in the component of its own text;
a null doc_id never names a component that has another id; empty tables and extra
columns are fine.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, freed_shuffles
from .components import components
from .textkit import SPACE_WORDS, mix, ngram_hashes, small_batches, split_words, texts_as_bytes

SCAN_COST = 8
POSTINGS_A_BATCH = 1 << 16
FILTER_BITS = 1 << 23                 # one bounded bitmap of candidate documents


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    joined, starts, ends = split_words(text, SPACE_WORDS)
    return np.unique(ngram_hashes(joined, starts, ends, min(n, len(starts)))) if len(starts) else np.empty(0, np.uint64)


def node_of(grams: np.ndarray) -> int:
    """Hash that names a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(grams).sum(dtype=np.uint64)[None] + np.uint64(len(grams))).view(np.int64)[0])


def need(a: int, b: int, percent: int) -> int:
    """Smallest overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (percent + 100))


def partners(size: int, percent: int) -> range:
    return range(-(-percent * size // 100), 100 * size // percent + 1)


@lru_cache(maxsize=1 << 16)
def subset_sizes(size: int, percent: int) -> tuple[int, ...]:
    return tuple(sorted({o for p in partners(size, percent) if (o := need(size, p, percent)) <= size}))


@lru_cache(maxsize=1 << 16)
def schemes(size: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(k parts, largest H) over all partners; k is a power of two that depends on H alone."""
    out: dict[int, int] = {}
    among = partners(size, percent)
    if size < 4096:
        for p in among:
            h = size + p - 2 * need(size, p, percent)
            out[parts_for(h)] = max(out.get(parts_for(h), 0), h)
        return tuple(sorted(out.items()))
    # H grows with the partner but for small steps back that repeat within percent + 100 sizes
    edge = percent + 100
    seen = [size + p - 2 * need(size, p, percent) for p in (*among[:edge], *among[-edge:])]
    k = parts_for(min(seen))
    while k <= parts_for(max(seen)):
        out[k] = min(max(seen), (10 * k - 10) // 13)   # the largest H of this k
        k *= 2
    return tuple(sorted(out.items()))


def parts_for(h: int) -> int:
    return 1 << max(2, (13 * h + 9) // 10).bit_length()


@lru_cache(maxsize=1 << 16)
def ways(size: int, percent: int, scan_cost: int = SCAN_COST) -> tuple[bool, bool]:
    """(enumerates subsets, is listed)."""
    light = _small(size, percent, scan_cost)
    return light, not light or not all(_small(p, percent, scan_cost) for p in partners(size, percent))


@lru_cache(maxsize=1 << 16)
def _small(size: int, percent: int, scan_cost: int) -> bool:
    listed = scan_cost * sum(h + 1 for _, h in schemes(size, percent))
    return size < 64 and sum(math.comb(size, c) for c in subset_sizes(size, percent)) <= listed


def keys_of(grams: np.ndarray, percent: int) -> np.ndarray:
    """List keys of a set: linked sets have one in common."""
    size = len(grams)
    if not size:
        return np.empty(0, dtype=np.uint64)
    light, listed = ways(size, percent)
    out = [np.empty(0, dtype=np.uint64)]
    with np.errstate(over="ignore"):
        if light:
            values = mix(grams)
            for c in subset_sizes(size, percent):
                drop = np.array(list(itertools.combinations(range(size), size - c)), dtype=np.int64).reshape(math.comb(size, c), size - c)
                out.append(mix(values.sum(dtype=np.uint64) - values[drop].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
        for k, h in schemes(size, percent) if listed else ():
            part = grams >> np.uint64(65 - k.bit_length())
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            count = np.diff(np.append(first, size))
            signs = mix(np.add.reduceat(mix(grams ^ np.uint64(k)), first) + part[first] + (np.uint64(k) << np.uint64(32)))
            sizes = np.bincount(count)
            sizes[0] = k - len(first)
            below = np.cumsum(sizes) - sizes           # parts with fewer n-grams than each count
            spare = k - h
            least = int(np.flatnonzero(below < spare)[-1])
            if least == 0:                             # too many empty parts: only such sets can miss each other
                out.append(mix(np.array([k], dtype=np.uint64) * np.uint64(0x51ED270B)))
                least = 1
            out.append(signs[count >= least])
    return np.unique(np.concatenate(out))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set, null if empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingles(text, n) for text in texts_as_bytes(b.column("text")))
            size, node = zip(*((len(g), node_of(g) if len(g) else None) for g in sets)) if len(b) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64())],
                                             names=["doc_id", "n_shingles", "node"])
    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint")


def postings(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node) of every list that a set stands in, once a node and task."""
    def listed(held: list[tuple]) -> pa.RecordBatch:
        key, node = (pa.array(np.concatenate(x)) for x in zip(*held))
        return pa.RecordBatch.from_arrays([key, node], names=["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for b in batches:
            for text in texts_as_bytes(b.column("text")):
                g = shingles(text, n)
                if not len(g) or (mark := node_of(g)) in seen:
                    continue
                if len(seen) > 1_000_000:              # spares work only; copies are dropped later too
                    seen.clear()
                seen.add(mark)
                keys = keys_of(g, percent).view(np.int64)
                held.append((keys, np.full(len(keys), mark, dtype=np.int64)))
                size += len(keys)
                if size >= POSTINGS_A_BATCH:
                    yield listed(held)
                    held, size = [], 0
        if held:
            yield listed(held)
    return docs.mapInArrow(run, "key bigint, node bigint")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node) rows to edges from the first node of a key to its others."""
    key = hub = None
    for b in batches:
        k, v = (np.asarray(b.column(c)) for c in ("key", "node"))
        if not len(k):
            continue
        first = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
        at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
        hubs = np.where(at >= 0, v[at], hub if hub is not None else 0)
        key, hub = k[-1], hubs[-1]
        edges = np.unique(np.stack([hubs, v], axis=1)[hubs != v], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = _bit(np.asarray(b.column("doc_id").fill_null(0)))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["word", "bits"])


def _candidate_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """node, text of the sets of documents that may be among ``chosen``, each node once
    (a bitmap of bounded size spares most others the shuffle; it never loses one)."""
    rows = chosen.select("doc_id").mapInArrow(_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    words = np.zeros(FILTER_BITS >> 5, dtype=np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(words.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for b in batches:
            at = _bit(np.asarray(b.column("doc_id").fill_null(0)))
            b = b.filter(pa.array((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            nodes, texts = [], []
            for text in texts_as_bytes(b.column("text")):
                g = shingles(text, n)
                if not len(g) or (mark := node_of(g)) in seen:
                    continue
                if len(seen) > 1_000_000:              # spares work only; copies are dropped below too
                    seen.clear()
                seen.add(mark)
                nodes.append(mark)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.binary())], names=["node", "text"])
    return docs.mapInArrow(run, "node bigint, text binary").dropDuplicates(["node"])


def linked(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> np.ndarray:
    """Component label (index of a member) of each set; with ``left`` (a mask),
    only pairs of one left and one other set count."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.arange(m)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(ids, kind="stable")
    posts = owner[order]
    begin = np.searchsorted(ids[order], np.arange(len(tokens) + 1))
    ends = np.cumsum(size)
    for i in range(m):
        if left is not None and not left[i]:
            continue
        mine = ids[ends[i] - size[i]:ends[i]]
        shared = mine[begin[mine + 1] - begin[mine] > 1]
        if not len(shared):
            continue
        both = np.bincount(np.concatenate([posts[begin[t]:begin[t + 1]] for t in shared]), minlength=m)
        ok = (percent + 100) * both >= percent * (size + size[i])
        if left is not None:
            ok &= ~left
        ok[i] = False
        for other in np.unique(label[ok]):
            if other != label[i]:
                lo, hi = sorted((int(other), int(label[i])))
                label[label == hi] = lo
    return label


def _verify(n: int, percent: int):
    """Rows sorted by (root, x, y, node) to edges (a, b) that span the linked nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets, sides = None, [], [], []

        def edges() -> pa.RecordBatch | None:
            if len(nodes) < 2:
                return None
            across = group[1] != group[2]
            label = linked(sets, percent, np.array(sides) == 0 if across else None)
            at = np.flatnonzero(label != np.arange(len(label)))
            names = np.array(nodes, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[label[at]])], names=["a", "b"]) if len(at) else None

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("root", "x", "y", "node", "side", "text")]
            for root, x, y, node, side, text in zip(*cols):
                if (root, x, y) != group:
                    if (out := edges()) is not None:
                        yield out
                    group, nodes, sets, sides = (root, x, y), [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(shingles(text, n))
        if (out := edges()) is not None:
            yield out
    return run


def join_components(docs: DataFrame, n: int = 4, percent: int = 85, cluster_grams: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    small_batches(docs.sparkSession)
    with freed_shuffles(docs.sparkSession):
        return _join_components(docs.select(F.col("doc_id").cast("long"), "text"), n, percent, cluster_grams)


def _join_components(docs: DataFrame, n: int, percent: int, cluster_grams: int) -> DataFrame:
    rows = cut_lineage(sketch(docs, n))
    met = postings(docs, n, percent).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a bigint, b bigint")
    clusters = components(met)
    # the smallest document of each set stands for all its copies
    nodes = cut_lineage(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    members = cut_lineage(nodes.join(clusters, "node"))
    sizes = members.groupBy("root").agg(F.sum("n").alias("grams")).where(F.col("grams") > cluster_grams)
    large = sizes.select("root", F.ceil(2 * F.col("grams") / cluster_grams).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a normal cluster is one task's (0, 0); a large one is compared block against block
    placed = members.join(large, "root", "left").withColumn("block", F.coalesce(block, F.lit(0))).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    placed = placed.select(
        "node", "root", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"),
        (F.col("block") > F.col("with")).cast("int").alias("side"))
    texts = _candidate_sets(docs, members, n)
    gathered = placed.join(texts, "node")            # by text: one doc_id, or none, may stand on several
    links = cut_lineage(gathered.select("root", "x", "y", "node", "side", "text").repartition("root", "x", "y")
                        .sortWithinPartitions("root", "x", "y", "node").mapInArrow(_verify(n, percent), "a bigint, b bigint"))
    label = components(links)
    named = cut_lineage(nodes.join(label, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = cut_lineage(named.join(smallest, "root").select("node", "component_id"))
    alone = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("node IS NOT NULL").join(final, "node").select("doc_id", "n_shingles", "component_id").union(alone)


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component: the one whose id names it. Documents without
    words or without doc_id stay; a row repeated whole is kept once."""
    stays = join_components(docs, n, percent).where((F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id")))
    stays = stays.select(F.col("doc_id").alias("_llm_kept")).where("_llm_kept IS NOT NULL").distinct()
    named = docs.where("doc_id IS NOT NULL")
    kept = named.join(stays, named["doc_id"].cast("long") == stays["_llm_kept"], "left_semi")
    whole = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]   # maps cannot be compared
    kept = kept.dropDuplicates(whole)
    return kept.union(docs.where("doc_id IS NULL"))

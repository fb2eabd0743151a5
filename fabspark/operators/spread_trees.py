"""Trees from frames with more rows than one task holds: every row is counted, none is drawn out.

The rows are binned once by cuts of all rows of the frame: midpoints of the values where there are few, of quantiles (a
summary of all rows within 1/10,000 of a rank) elsewhere. Codes take a byte. They stay in their tasks; what moves are
histograms of the open nodes, added up by (model, node, some features), and the best cut of each.

* Boosting (``spread_boost``): codes lie in blocks, all models of a batch grow their next tree in the same jobs. A round
  counts the nodes that best-first growth may split next, then growth goes on as far as the counts reach. Margins are
  renewed every ``TREES_A_MARGIN`` trees, from the codes and all trees so far.
* Forests (``spread_forest``): the rows that some trees drew are held; nodes of more than ``task_rows`` copies are split
  by histograms of all their rows, smaller ones are grown to their end in one task each, like the trees of a small frame.

The same rules as in ``trees.grow``; samples of rows and features are drawn by hash and by node instead of one after another.
"""
from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import h32
from ..session import cut_lineage
from . import trees as T

BLOCK = 4096                         # rows of a block of codes
CHUNK = 8                            # features whose counts move together
NODES_A_ROUND = 32                   # nodes of a model that are counted at once
MODELS_A_BATCH = 8                   # boosted models that grow side by side
TREES_A_MARGIN = 8
ACCURACY = 10_000
SPLITS = "model int, node int, chunk int, gain double, feature int, code int, g double, h double, n double, lg double, lh double, ln double"


# --------------------------------------------------------------------- codes
def frame_edges(rows: DataFrame, max_bins: int = T.MAX_BINS) -> dict[int, list[np.ndarray]]:
    """Bin edges of every feature of every frame, from all rows."""
    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for frame, part in b.groupby("frame"):
                x = np.stack(part["features"]).astype(float)
                for j in range(x.shape[1]):
                    before = held.get((frame, j), np.empty(0))
                    if before is not None:
                        v = np.unique(np.concatenate([before, x[:, j]]))
                        held[frame, j] = v if len(v) <= max_bins else None
        yield pd.DataFrame([(f, j, None if v is None else v.tolist()) for (f, j), v in held.items()], columns=["frame", "feature", "v"])

    found = rows.select("frame", "features").mapInPandas(values, "frame int, feature int, v array<double>").groupBy("frame", "feature").agg(
        F.max(F.col("v").isNull()).alias("many"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))), 1, max_bins + 1).alias("v"))
    few = {(r["frame"], r["feature"]): None if r["many"] or len(r["v"]) > max_bins else r["v"] for r in found.collect()}    # a row a feature
    many = [k for k, v in few.items() if v is None]
    if many:
        listed = rows.sparkSession.createDataFrame(many, "frame int, feature int")
        ranks = [float(p) for p in np.linspace(0, 1, max_bins + 1)]
        cut = (rows.select("frame", F.posexplode("features").alias("feature", "v")).join(F.broadcast(listed), ["frame", "feature"])
               .groupBy("frame", "feature").agg(F.percentile_approx("v", ranks, ACCURACY).alias("v")))
        for r in cut.collect():                                               # a row a feature
            few[r["frame"], r["feature"]] = sorted(set(r["v"]))
    out: dict[int, list[np.ndarray]] = {}
    for frame, j in sorted(few):
        v = np.array(few[frame, j], dtype=float)
        out.setdefault(frame, []).append((v[1:] + v[:-1]) / 2)
    return out


class Coded(T.Bins):
    """Rows that have their codes already."""

    def __init__(self, codes: np.ndarray, edges: list[np.ndarray]):
        self.codes, self.edges = codes, edges
        self.width = width_of(edges)


def width_of(edges: list[np.ndarray]) -> int:
    return max((len(e) for e in edges), default=0) + 1


def coded_rows(rows: DataFrame, edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """(frame, unit_id, y, codes), checkpointed: a byte a feature."""
    cuts = rows.sparkSession.sparkContext.broadcast(edges)                    # bins x features x frames

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, part in b.groupby("frame"):
                x = np.stack(part["features"]).astype(float)
                codes = np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(cuts.value[frame])], axis=1)
                yield part.drop(columns="features").assign(codes=[c.tobytes() for c in codes])
    kind = dict(rows.dtypes)["unit_id"]
    return cut_lineage(rows.select("frame", "unit_id", "y", "features").mapInPandas(code, f"frame int, unit_id {kind}, y int, codes binary"))


def _blocks(coded: DataFrame) -> DataFrame:
    """(frame, place, y, codes): ``BLOCK`` rows a row; ``place`` is the hash of the id."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(frame: int) -> pa.RecordBatch:
            place, y, codes = zip(*held.pop(frame))
            return pa.RecordBatch.from_arrays([pa.array([frame], pa.int32()), pa.array([np.array(place, np.int64).tobytes()]),
                                               pa.array([np.array(y, np.uint8).tobytes()]), pa.array([b"".join(codes)])],
                                              names=["frame", "place", "y", "codes"])
        for b in batches:
            for frame, *row in zip(*(b.column(c).to_pylist() for c in ("frame", "place", "y", "codes"))):
                held.setdefault(frame, []).append(row)
                if len(held[frame]) == BLOCK:
                    yield out(frame)
        for frame in list(held):
            yield out(frame)
    named = coded.select("frame", h32(F.concat(F.coalesce(F.col("unit_id").cast("string"), F.lit("")), F.lit(":rows"))).alias("place"), "y", "codes")
    return named.mapInArrow(pack, "frame int, place binary, y binary, codes binary")


# ---------------------------------------------------------------- best cuts
def _chunks(model: int, nodes: list[int], sums: np.ndarray, chunk: int) -> Iterator[tuple]:
    """Rows (model, node, chunk, sums) of an array (3, nodes, features, bins)."""
    for k, node in enumerate(nodes):
        for c in range(0, sums.shape[2], chunk):
            yield model, node, c, np.ascontiguousarray(sums[:, k, c:c + chunk]).tobytes()


def _add(codes: np.ndarray, slot: np.ndarray, values: tuple, sums: np.ndarray) -> None:
    """Adds rows with a slot (an open node; -1: none) to the sums of their bins."""
    at = np.flatnonzero(slot >= 0)
    if not len(at):
        return
    _, open_, wide, width = sums.shape
    flat = ((slot[at].astype(np.int64)[:, None] * wide + np.arange(wide)) * width + codes[at]).ravel()
    for s, v in enumerate(values):
        sums[s] += np.bincount(flat, np.repeat(v[at], wide), open_ * wide * width).reshape(open_, wide, width)


def _reached(tree: dict, codes: np.ndarray) -> np.ndarray:
    """Node that each row has come to."""
    feature, code, left, right = (np.array(tree[k]) for k in ("feature", "code", "left", "right"))
    at, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while (inner := feature[at] >= 0).any():
        near = codes[rows, np.maximum(feature[at], 0)] <= code[at]
        at = np.where(inner, np.where(near, left[at], right[at]), at)
    return at


def _best(counted: DataFrame, widths: dict[int, int], limits: dict[int, T.Growth], columns: dict[int, np.ndarray | None]) -> list:
    """The best cut of each (model, node, chunk), and the sums of the node and its left side."""
    def best(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        model, node, chunk = (int(k) for k in key)
        width, rule = widths[model], limits[model]
        hist = sum(np.frombuffer(s).reshape(3, -1, width) for s in group.sort_values("part")["sums"])      # the same sums in any run
        total = hist[:, 0].sum(axis=1)
        left = hist.cumsum(axis=2)[:, :, :-1]
        right = hist.sum(axis=2, keepdims=True) - left
        score = lambda s: s[0] ** 2 / np.maximum(s[1] + rule.l2, 1e-12)
        gain = score(left) + score(right) - total[0] ** 2 / max(total[1] + rule.l2, 1e-12)
        small = (left[2] < rule.min_rows) | (right[2] < rule.min_rows) | (left[1] < rule.min_hessian) | (right[1] < rule.min_hessian)
        shut = np.zeros(hist.shape[1], dtype=bool) if columns[model] is None else ~np.isin(chunk + np.arange(hist.shape[1]), columns[model])
        gain[small | (left[2] <= 0) | (right[2] <= 0) | shut[:, None]] = -np.inf
        if not gain.size:
            return pd.DataFrame([(model, node, chunk, -np.inf, chunk, 0, *total, 0.0, 0.0, 0.0)])
        f, code = np.unravel_index(gain.argmax(), gain.shape)
        return pd.DataFrame([(model, node, chunk, gain[f, code], chunk + f, code, *total, *left[:, f, code])])
    return counted.groupBy("model", "node", "chunk").applyInPandas(best, SPLITS).collect()      # nodes x chunks


COUNTED = "model int, node int, chunk int, sums binary, part int"


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    model, node, chunk, sums = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(node, pa.int32()), pa.array(chunk, pa.int32()),
                                       pa.array(sums, pa.binary()), pa.array([part] * len(rows), pa.int32())],
                                      names=["model", "node", "chunk", "sums", "part"])


class _Partial:
    """A tree while it grows: nodes as far as they are counted, ``splits`` of those that can be split."""

    def __init__(self):
        self.tree: dict[str, list] = {k: [] for k in ("feature", "edge", "left", "right", "value", "gain", "code")}
        self.depth: list[int] = []
        self.sums: list[tuple | None] = []
        self.splits: dict[int, tuple] = {}
        self.open = [self.add(0, None)]

    def add(self, depth: int, sums: tuple | None) -> int:
        for k, v in (("feature", -1), ("edge", 0.0), ("left", 0), ("right", 0), ("value", 0.0), ("gain", 0.0), ("code", 0)):
            self.tree[k].append(v)
        self.depth.append(depth)
        self.sums.append(sums)
        return len(self.depth) - 1

    def counted(self, found: dict[int, tuple]) -> None:
        """``found``: node -> (gain, feature, code, sums of the node, sums of its left side); without a split gain is -inf."""
        for node, split in found.items():
            self.sums[node] = split[3] if self.sums[node] is None else self.sums[node]
            if split[0] > 1e-12:
                self.splits[node] = split
        self.open = [n for n in self.open if n not in found]

    def split(self, node: int, edges: list[np.ndarray]) -> tuple[int, int]:
        gain, f, code, total, left = self.splits[node]
        right = tuple(a - b for a, b in zip(self.sums[node], left))
        near, far = self.add(self.depth[node] + 1, left), self.add(self.depth[node] + 1, right)
        for k, v in (("feature", f), ("code", code), ("edge", float(edges[f][code])), ("gain", gain), ("left", near), ("right", far)):
            self.tree[k][node] = v
        return near, far


# ------------------------------------------------------------------ boosting
class _Boosted:
    """A boosted model while it grows."""

    def __init__(self, spec: dict, counts: dict[int, int], edges: list[np.ndarray], seed: int):
        p = spec["params"]
        self.spec, self.edges, self.seed, self.params = spec, edges, seed, p
        self.weights = {c: float(spec["weights"].get(c, 1.0)) for c in counts}
        positive = sum(self.weights[c] * n * c for c, n in counts.items())
        share = min(max(positive / sum(self.weights[c] * n for c, n in counts.items()), 1e-12), 1 - 1e-12)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        self.limits = T.Growth(p.get("max_leaf_nodes"), p.get("max_depth"), p.get("min_samples_leaf", 1),
                               p.get("min_child_weight", 1e-3), p.get("l2_regularization", 1.0))
        self.start()

    def start(self) -> None:
        wide, share = len(self.edges), self.params.get("colsample_bytree", 1.0)
        rng = np.random.default_rng([self.seed, len(self.trees)])
        self.columns = rng.choice(wide, max(1, int(share * wide)), replace=False) if share < 1 else None
        self.partial = _Partial()

    @property
    def done(self) -> bool:
        return len(self.trees) >= int(self.params["n_trees"])

    def _order(self) -> tuple[list[int], list[int]]:
        """Best-first growth as far as the counts reach: the nodes split, in order, and those to be split next."""
        tree, limits, waiting, split = self.partial.tree, self.limits, [], []

        def push(node: int) -> None:
            if node in self.partial.splits and (limits.max_depth is None or self.partial.depth[node] < limits.max_depth):
                heapq.heappush(waiting, (-self.partial.splits[node][0], rank[node], node))
        rank = {0: 0}
        push(0)
        while waiting and (limits.max_leaves is None or len(split) + 1 < limits.max_leaves):
            _, _, node = waiting[0]
            if tree["feature"][node] < 0:                       # its sides are not counted: it and the best others are next
                left = None if limits.max_leaves is None else limits.max_leaves - 1 - len(split)
                return split, [n for _, _, n in sorted(waiting)[:left] if tree["feature"][n] < 0]
            heapq.heappop(waiting)
            split.append(node)
            for child in (tree["left"][node], tree["right"][node]):
                rank[child] = len(rank)
                push(child)
        return split, []

    def advance(self) -> None:
        """Splits nodes until some must be counted, or the tree is whole and the next one starts."""
        while not self.partial.open:
            split, near = self._order()
            if not near:
                self._keep(split)
                if self.done:
                    return
                self.start()
                return
            for node in near[:max(1, NODES_A_ROUND // 2)]:
                sides = self.partial.split(node, self.edges)
                depth, limits = self.partial.depth[node] + 1, self.limits
                if limits.max_depth is None or depth < limits.max_depth:
                    self.partial.open += [s for s in sides if self.partial.sums[s][2] >= 2 * max(1, limits.min_rows)]

    def _keep(self, split: list[int]) -> None:
        """The tree of the nodes that were split, its nodes in the order of growth."""
        grown, kept, place = self.partial, {k: [] for k in self.partial.tree}, {0: 0}

        def add(node: int) -> None:
            g, h, _ = grown.sums[node]
            rate = float(self.params["learning_rate"])
            for k, v in (("feature", -1), ("edge", 0.0), ("left", 0), ("right", 0), ("gain", 0.0), ("code", 0),
                         ("value", rate * float(g / (h + self.limits.l2)) if h + self.limits.l2 else 0.0)):
                kept[k].append(v)
        add(0)
        for node in split:
            at = place[node]
            for k in ("feature", "edge", "gain", "code"):
                kept[k][at] = grown.tree[k][node]
            for side in ("left", "right"):
                child = grown.tree[side][node]
                place[child] = kept[side][at] = len(place)
                add(child)
        self.trees.append(kept)


def _margin(trees: list[dict], codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for tree in trees:
        out += np.array(tree["value"])[_reached(tree, codes)]
    return out


def _columns(batch: pa.RecordBatch, wide: dict[int, int]) -> Iterator[tuple]:
    for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
        frame, place, y, codes, *margin = row
        y = np.frombuffer(y, np.uint8).astype(float)
        yield row, frame, np.frombuffer(place, np.int64), y, np.frombuffer(codes, np.uint8).reshape(-1, wide[frame]), margin


def spread_boost(coded: DataFrame, models: list[dict], edges: dict[int, list[np.ndarray]], seed: int) -> list[tuple[float, list[dict]]]:
    """(base, trees) of every model, grown from all rows of its frame."""
    counts: dict[int, dict[int, int]] = {}
    for r in coded.groupBy("frame", "y").count().collect():
        counts.setdefault(r["frame"], {})[r["y"]] = r["count"]
    blocks = cut_lineage(_blocks(coded.where(F.col("frame").isin(sorted({m["frame"] for m in models})))))
    out = []
    for lo in range(0, len(models), MODELS_A_BATCH):
        some = [_Boosted(m, counts[m["frame"]], edges[m["frame"]], seed) for m in models[lo:lo + MODELS_A_BATCH]]
        _grow_side_by_side(blocks, some)
        out += [(m.base, m.trees) for m in some]
    return out


def _grow_side_by_side(blocks: DataFrame, models: list[_Boosted]) -> None:
    by_frame: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        by_frame.setdefault(m.spec["frame"], []).append(i)
    blocks = blocks.where(F.col("frame").isin(sorted(by_frame)))
    wide = {m.spec["frame"]: len(m.edges) for m in models}
    widths, limits = {i: width_of(m.edges) for i, m in enumerate(models)}, {i: m.limits for i, m in enumerate(models)}
    bases = [m.base for m in models]
    held, upto = None, [0] * len(models)

    def with_margins() -> DataFrame:
        """Blocks with the margins of all models, from all trees that stand: the plan does not grow with the rounds."""
        shared = blocks.sparkSession.sparkContext.broadcast([m.trees for m in models])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, frame, _, y, codes, _ in _columns(b, wide):
                    margins = np.stack([_margin(shared.value[i], codes, np.full(len(y), bases[i])) for i in by_frame[frame]])
                    yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int32()), *[pa.array([v], pa.binary()) for v in (*row[1:4], margins.tobytes())]],
                                                     names=["frame", "place", "y", "codes", "margins"])
        return blocks.mapInArrow(run, "frame int, place binary, y binary, codes binary, margins binary").persist(StorageLevel.MEMORY_AND_DISK)

    try:
        for m in models:
            if not m.done:
                m.advance()
        while not all(m.done for m in models):
            if held is None or any(len(m.trees) - upto[i] >= TREES_A_MARGIN for i, m in enumerate(models)):
                if held is not None:
                    held.unpersist()
                held, upto = with_margins(), [len(m.trees) for m in models]
            _round(held, models, by_frame, wide, widths, limits, upto)
    finally:
        if held is not None:
            held.unpersist()


def _round(held: DataFrame, models: list[_Boosted], by_frame: dict, wide: dict, widths: dict, limits: dict, upto: list[int]) -> None:
    """Counts the open nodes of all models and lets each grow as far as that reaches."""
    work = {i: {"tree": m.partial.tree, "open": list(m.partial.open), "trees": m.trees[upto[i]:], "weights": m.weights,
                "sample": float(m.params.get("subsample", 1.0)), "number": len(m.trees), "seed": m.seed}
            for i, m in enumerate(models) if not m.done}
    shared = held.sparkSession.sparkContext.broadcast(work)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: None for i in shared.value}
        for b in batches:
            for _, frame, place, y, codes, (margins,) in _columns(b, wide):
                margins = np.frombuffer(margins).reshape(len(by_frame[frame]), -1)
                for i, start in zip(by_frame[frame], margins):
                    if i not in shared.value:
                        continue
                    w = shared.value[i]
                    p = 1 / (1 + np.exp(-_margin(w["trees"], codes, start)))
                    weight = np.where(y == 1, w["weights"].get(1, 1.0), w["weights"].get(0, 1.0))
                    slots = np.full(len(w["tree"]["feature"]), -1)
                    slots[w["open"]] = np.arange(len(w["open"]))
                    slot = slots[_reached(w["tree"], codes)]
                    if w["sample"] < 1:
                        slot = np.where(_share(place, w["seed"], w["number"]) < w["sample"], slot, -1)
                    if sums[i] is None:
                        sums[i] = np.zeros((3, len(w["open"]), wide[frame], widths[i]))
                    _add(codes, slot, (weight * (y - p), weight * p * (1 - p), np.ones(len(y))), sums[i])
        for i, s in sums.items():
            if s is not None:
                yield _as_batch(list(_chunks(i, shared.value[i]["open"], s, CHUNK)))
    rows = _best(held.mapInArrow(count, COUNTED), widths, limits, {i: m.columns for i, m in enumerate(models)})
    shared.unpersist()
    found: dict[int, dict[int, tuple]] = {i: {} for i in work}
    for r in sorted(rows, key=lambda r: (r["model"], r["node"], r["chunk"])):
        best = found[r["model"]].get(r["node"])
        if best is None or r["gain"] > best[0]:
            total = best[3] if best else (r["g"], r["h"], r["n"])
            found[r["model"]][r["node"]] = (r["gain"], r["feature"], r["code"], total, (r["lg"], r["lh"], r["ln"]))
    for i in work:
        for node in work[i]["open"]:                                  # no row of the sample came here
            found[i].setdefault(node, (-np.inf, 0, 0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)))
        models[i].partial.counted(found[i])
        models[i].advance()


def _share(place: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in [0, 1) for each row and tree, from the hash of the row's id."""
    with np.errstate(over="ignore"):
        v = place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64((number + 1) * 1_000_003 + seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


# ------------------------------------------------------------------- forests
def spread_forest(coded: DataFrame, draws: DataFrame, spec: dict, edges: list[np.ndarray], seed: int, task_rows: int) -> list[dict]:
    """The trees of one forest; ``draws`` (tree, unit_id, y, copies) are those of its frame."""
    out, n = [], int(spec["params"]["n_estimators"])
    for lo in range(0, n, T.TREES_A_TASK):
        among = draws.where(F.col("tree").between(lo, min(n, lo + T.TREES_A_TASK) - 1)).select("tree", "unit_id", "copies")
        drawn = among.join(coded.select("unit_id", "y", "codes"), "unit_id").select("tree", "y", "copies", "codes")
        drawn = drawn.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            out += _some_trees(drawn, spec, edges, seed, task_rows)
        finally:
            drawn.unpersist()
    return out


def _some_trees(drawn: DataFrame, spec: dict, edges: list[np.ndarray], seed: int, task_rows: int) -> list[dict]:
    p, wide, width = spec["params"], len(edges), width_of(edges)
    limits = T.Growth(None, p.get("max_depth"), int(p.get("min_samples_leaf", 1)), features=T.drawn_features(p["max_features"], wide))
    weights = {c: float(spec["weights"].get(c, 1.0)) for c in (0, 1)}
    copies = {r["tree"]: r["n"] for r in drawn.groupBy("tree").agg(F.sum("copies").alias("n")).collect()}       # a row a tree
    partial = {t: _Partial() for t in sorted(copies)}
    large = [(t, 0) for t in partial if copies[t] > task_rows]
    small = [(t, 0) for t in partial if copies[t] <= task_rows]
    while large:
        now, large = large[:NODES_A_ROUND], large[NODES_A_ROUND:]
        for (t, node), split in _node_splits(drawn, now, partial, weights, limits, wide, width, seed).items():
            grown = partial[t]
            grown.counted({node: split})
            if node not in grown.splits:
                continue                                            # a leaf
            for child in grown.split(node, edges):
                if limits.max_depth is None or grown.depth[child] < limits.max_depth:
                    (large if grown.sums[child][2] > task_rows else small).append((t, child))
    ends = _grown_to_the_end(drawn, small, partial, weights, limits, edges, seed)
    out = []
    for t, grown in partial.items():
        tree = grown.tree
        tree["value"] = [float(s[0] / s[1]) if s is not None and s[1] else 0.0 for s in grown.sums]
        for node, end in sorted(ends.get(t, {}).items()):
            at = len(tree["value"]) - 1                             # the end's root takes the node's place, the others follow
            moved = {**end, **{side: [v + at if v else 0 for v in end[side]] for side in ("left", "right")}}
            for k in tree:
                tree[k][node] = moved[k][0]
                tree[k] += moved[k][1:]
        out.append(tree)
    return out


def _by_tree(batch: pd.DataFrame, wide: int, weights: dict[int, float]) -> Iterator[tuple]:
    for t, rows in batch.groupby("tree"):
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, wide)
        y, times = rows["y"].to_numpy().astype(float), rows["copies"].to_numpy().astype(float)
        yield int(t), codes, y, times, np.where(y == 1, weights[1], weights[0])


def _node_splits(drawn: DataFrame, nodes: list[tuple[int, int]], partial: dict[int, _Partial], weights: dict, limits: T.Growth, wide: int,
                 width: int, seed: int) -> dict[tuple[int, int], tuple]:
    """The split of each (tree, node), by histograms of all its rows; of the features that the node draws, the best, or the
    first one after them that splits."""
    of: dict[int, list[int]] = {}
    for t, node in nodes:
        of.setdefault(t, []).append(node)
    trees = {t: partial[t].tree for t in of}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for b in batches:
            for t, codes, y, times, weight in _by_tree(b, wide, weights):
                slots = np.full(len(trees[t]["feature"]), -1)
                slots[of[t]] = np.arange(len(of[t]))
                if t not in sums:
                    sums[t] = np.zeros((3, len(of[t]), wide, width))
                _add(codes, slots[_reached(trees[t], codes)], (times * weight * y, times * weight, times), sums[t])
        part = TaskContext.get().partitionId()
        for t, s in sums.items():
            yield pd.DataFrame([(*row, part) for row in _chunks(t, of[t], s, 1)], columns=["model", "node", "chunk", "sums", "part"])
    counted = drawn.where(F.col("tree").isin(sorted(of))).mapInPandas(count, COUNTED)
    cuts: dict[tuple[int, int], dict[int, tuple]] = {}
    for r in _best(counted, dict.fromkeys(of, width), dict.fromkeys(of, limits), dict.fromkeys(of)):
        cuts.setdefault((r["model"], r["node"]), {})[r["feature"]] = (r["gain"], r["feature"], r["code"], (r["g"], r["h"], r["n"]), (r["lg"], r["lh"], r["ln"]))
    out = {}
    for key in nodes:
        order = [int(f) for f in np.random.default_rng([seed, *key]).permutation(wide)]
        found = [f for f in order if cuts[key][f][0] > 1e-12]
        first = [f for f in order[:limits.features] if f in found] or found[:1] or order[:1]
        out[key] = max((cuts[key][f] for f in first), key=lambda c: (c[0], -c[1]))
    return out


def _grown_to_the_end(drawn: DataFrame, nodes: list[tuple[int, int]], partial: dict[int, _Partial], weights: dict, limits: T.Growth,
                      edges: list[np.ndarray], seed: int) -> dict[int, dict[int, dict]]:
    """What grows out of each (tree, node) that one task holds."""
    wide, trees = len(edges), {t: p.tree for t, p in partial.items()}
    depth, wanted = {(t, n): partial[t].depth[n] for t, n in nodes}, {}
    for t, n in nodes:
        wanted.setdefault(t, []).append(n)
    if not nodes:
        return {}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, rows in b.groupby("tree"):
                at = _reached(trees[t], np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, wide))
                rows = rows.assign(node=at)
                yield rows[np.isin(at, wanted.get(int(t), []))]

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, node = int(key[0]), int(key[1])
        (_, codes, y, times, weight), = _by_tree(rows, wide, weights)
        order = np.lexsort([*codes.T[:8], y])
        codes, y, times, weight = codes[order], y[order], times[order], weight[order]
        rule = T.Growth(None, None if limits.max_depth is None else limits.max_depth - depth[t, node], limits.min_rows, features=limits.features)
        tree, _ = T.grow(Coded(codes, edges), np.arange(len(y)), times * weight * y, times * weight, times, rule, np.random.default_rng([seed, t, node]))
        return pd.DataFrame({"tree": [t], "node": [node], "state": [T.json.dumps(tree)]})
    placed = drawn.mapInPandas(place, "tree int, y int, copies bigint, codes binary, node int")
    ends: dict[int, dict[int, dict]] = {}
    for r in placed.groupBy("tree", "node").applyInPandas(fit, "tree int, node int, state string").collect():   # nodes of the trees
        ends.setdefault(r["tree"], {})[r["node"]] = T.json.loads(r["state"])
    return ends


def fit_spread(rows: DataFrame, models: list[dict], seed: int, task_rows: int) -> list[T.TreeEnsemble]:
    """One ensemble an entry of ``models``, from all of ``rows`` (frame, unit_id, y, features)."""
    edges = frame_edges(rows)
    coded = coded_rows(rows, edges)
    boosted = [m for m in models if m["estimator"] != "balanced_rf"]
    grown = iter(spread_boost(coded, boosted, edges, seed) if boosted else [])
    most: dict[int, int] = {}
    for m in models:
        if m["estimator"] == "balanced_rf":
            most[m["frame"]] = max(most.get(m["frame"], 0), int(m["params"]["n_estimators"]))
    draws = {f: cut_lineage(T.balanced_draws(coded.where(F.col("frame") == f).select("frame", "unit_id", "y"), n, seed)) for f, n in most.items()}
    out = []
    for m in models:
        if m["estimator"] != "balanced_rf":
            base, trees = next(grown)
        else:
            mine = coded.where(F.col("frame") == m["frame"])
            base, trees = 0.0, spread_forest(mine, draws[m["frame"]], m, edges[m["frame"]], seed, task_rows)
        ensemble = T.TreeEnsemble(m["estimator"] != "balanced_rf", base)
        for tree in trees:
            ensemble.add(tree)
        out.append(ensemble)
    return out

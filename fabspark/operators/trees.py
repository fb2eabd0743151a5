"""Tree ensembles on histograms: regularised boosting and balanced random forests.

Spark prepares what the trees are grown from: the labelled rows of all folds' frames, and for forests one seeded
table of draws (frame, tree, row, copies) with equal class sizes. All models (folds x draws of parameters x
configurations) on frames of up to ``MAX_ROWS`` rows are grown in ONE job, keyed by model; a forest is dealt over
several tasks, some trees each, and a task holds one frame. Larger frames stay where they lie, and trees grow from
histograms of all their rows (``spread_trees``). ``root_gains`` is the first split's gain of every feature and bin over
all rows, by aggregation alone.

A split's gain is GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2), with gradients and hessians of the log loss for
boosting, and copies of positives and of all rows for forests (then it is the fall of the Gini index). Leaves are
split best first up to ``max_leaf_nodes``, or all of them down to ``max_depth``; a side needs ``min_samples_leaf``
rows and a hessian of ``min_child_weight``.
"""
from __future__ import annotations

import heapq
import json
import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import h32, h60
from ..session import cut_lineage
from .split import SEED, seeded_rank

MAX_ROWS = 100_000                   # labelled rows of a frame that one task holds
MAX_BINS = 255
TREES_A_TASK = 25
SUM_ENTRIES = 1 << 20                # codes that are counted at once
HELD_HISTOGRAMS = 256                # of leaves that wait to be split; the others are counted again


KINDS = {"roots": "q", "feature": "i", "edge": "d", "left": "i", "right": "i", "value": "d", "gain": "d"}


@dataclass
class TreeEnsemble:
    """Nodes of all trees in flat arrays of plain numbers (36 bytes a node); ``feature`` -1 marks a leaf. Boosted trees add
    up to a margin, a forest's trees average to a probability."""
    boosted: bool
    base: float
    roots: array = ()
    feature: array = ()
    edge: array = ()
    left: array = ()
    right: array = ()
    value: array = ()
    gain: array = ()

    def __post_init__(self):
        for name, kind in KINDS.items():
            setattr(self, name, array(kind, getattr(self, name)))

    def add(self, tree: dict) -> None:
        at = len(self.feature)
        self.roots.append(at)
        self.left.extend(v + at for v in tree["left"])
        self.right.extend(v + at for v in tree["right"])
        for name in ("feature", "edge", "value", "gain"):
            getattr(self, name).extend(array(KINDS[name], tree[name]))

    def append(self, more: TreeEnsemble) -> None:
        """The trees of ``more`` after those that stand."""
        at = len(self.feature)
        for name in ("roots", "left", "right"):
            getattr(self, name).extend(array(KINDS[name], (v + at for v in getattr(more, name))))
        for name in ("feature", "edge", "value", "gain"):
            getattr(self, name).extend(getattr(more, name))

    def importances(self, width: int) -> list[float]:
        """Share of each feature in the gain: summed over splits for forests, per split for boosted trees."""
        total, splits = np.zeros(width), np.zeros(width)
        for f, g in zip(self.feature, self.gain):
            if f >= 0:
                total[f] += g
                splits[f] += 1
        if self.boosted:
            total = total / np.maximum(splits, 1)
        return (total / total.sum() if total.sum() else total).tolist()

    def probability(self, rows: np.ndarray) -> np.ndarray:
        feature, left, right = (np.array(x, dtype=np.int64) for x in (self.feature, self.left, self.right))
        edge, value, roots = (np.array(x) for x in (self.edge, self.value, self.roots))
        out, step = np.empty(len(rows)), max(1, 2_000_000 // max(1, len(roots)))
        for lo in range(0, len(rows), step):
            x = rows[lo:lo + step]
            at = np.tile(roots, (len(x), 1)).astype(np.int64)
            while (inner := feature[at] >= 0).any():
                near = x[np.arange(len(x))[:, None], np.maximum(feature[at], 0)] <= edge[at]
                at = np.where(inner, np.where(near, left[at], right[at]), at)
            out[lo:lo + step] = value[at].sum(axis=1) if self.boosted else value[at].mean(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.base + out, -500, 500))) if self.boosted else out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``probability``, a vector of both classes, like the library's own models."""
        shared = df.sparkSession.sparkContext.broadcast(self)          # bounded by trees x leaves

        @F.pandas_udf("double")
        def fail(column: pd.Series) -> pd.Series:
            return pd.Series(shared.value.probability(np.stack(column)) if len(column) else [], dtype="float64")
        return (df.withColumn("_p", fail(features))
                .withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p"))

    def to_json(self) -> str:
        return json.dumps({k: list(v) if k in KINDS else v for k, v in self.__dict__.items()})

    @staticmethod
    def from_json(state: str) -> TreeEnsemble:
        return TreeEnsemble(**json.loads(state))


def scored_together(rows: DataFrame, ensembles: dict[int, list[tuple[int, TreeEnsemble]]]) -> DataFrame:
    """(config, fold, unit_id, y, score) of ``rows`` (fold, unit_id, y, features) by every (config, ensemble) of their fold,
    in one pass: one plan, however many models there are."""
    shared = rows.sparkSession.sparkContext.broadcast(ensembles)               # bounded by models x trees x leaves

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold in b.column("fold").unique().to_pylist():
                mine = b.filter(pc.equal(b.column("fold"), fold)) if fold is not None else b.slice(0, 0)
                for config, ensemble in shared.value.get(fold, []):
                    x = mine.column("features").flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([config] * mine.num_rows, pa.int32()), *(mine.column(c) for c in ("fold", "unit_id", "y")), pa.array(ensemble.probability(x))],
                        names=["config", "fold", "unit_id", "y", "score"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(score, f"config int, fold {kinds['fold']}, unit_id {kinds['unit_id']}, y {kinds['y']}, score double")


# ------------------------------------------------------------------ growing
class Bins:
    """Rows by bin: bin b of a feature holds values up to its b-th edge."""

    def __init__(self, x: np.ndarray, max_bins: int = MAX_BINS):
        self.edges = [self._cut(x[:, j], max_bins) for j in range(x.shape[1])]
        self.width = max((len(e) for e in self.edges), default=0) + 1
        self.codes = np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.int16) for j, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _cut(v: np.ndarray, max_bins: int) -> np.ndarray:
        values = np.unique(v)
        if len(values) > max_bins:
            values = np.unique(np.quantile(v, np.linspace(0, 1, max_bins + 1)))
        return (values[1:] + values[:-1]) / 2


@dataclass
class Growth:
    max_leaves: int | None = None
    max_depth: int | None = None
    min_rows: int = 1
    min_hessian: float = 0.0
    l2: float = 0.0
    features: int | None = None              # drawn anew at every node


def grow(bins: Bins, rows: np.ndarray, g: np.ndarray, h: np.ndarray, count: np.ndarray, limits: Growth,
         rng: np.random.Generator, columns: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """One tree and the leaf value of every given row. ``g``, ``h`` and ``count`` are of all rows. Where features are
    drawn at every node and all sums are whole numbers, only the drawn features are counted: the same tree, for whole
    numbers give the same sums in any order."""
    wide, held = bins.codes.shape[1], [0]
    allowed = np.zeros(wide, dtype=bool)
    allowed[np.arange(wide) if columns is None else columns] = True
    tree: dict[str, list] = {k: [] for k in ("feature", "edge", "left", "right", "value", "gain", "code")}
    members: list[np.ndarray] = []
    waiting: list[tuple] = []

    lazy = (limits.features is not None and limits.features < wide and limits.l2 == 0
            and all(np.array_equal(v[rows], np.floor(v[rows])) for v in (g, h, count)))

    def gains(hist: np.ndarray, total_g: float, total_h: float, open_: np.ndarray) -> np.ndarray:
        left = hist.cumsum(axis=2)[:, :, :-1]
        right = hist.sum(axis=2, keepdims=True) - left
        score = lambda s: s[0] ** 2 / np.maximum(s[1] + limits.l2, 1e-12)
        gain = score(left) + score(right) - total_g ** 2 / max(total_h + limits.l2, 1e-12)
        small = (left[2] < limits.min_rows) | (right[2] < limits.min_rows) | (left[1] < limits.min_hessian) | (right[1] < limits.min_hessian)
        gain[small | (left[2] <= 0) | (right[2] <= 0) | ~open_[:, None]] = -np.inf
        return gain

    def drawn_split(at: np.ndarray, total_g: float, total_h: float) -> tuple[float, int, int] | None:
        """Gain, feature and code of the best of the drawn features, or of the first one after them that splits."""
        order = rng.permutation(wide)
        if total_g == 0 or total_g == total_h:                     # one class
            return None
        for lo in range(0, wide, limits.features):
            columns = order[lo:lo + limits.features]
            flat = (bins.codes[at[:, None], columns] + np.arange(len(columns)) * bins.width).ravel()
            hist = np.stack([np.bincount(flat, np.repeat(v[at], len(columns)), len(columns) * bins.width).reshape(-1, bins.width)
                             for v in (g, h, count)])
            gain = gains(hist, total_g, total_h, allowed[columns])
            best = gain.max(axis=1, initial=-np.inf)
            found = np.flatnonzero(best > 1e-12)
            if len(found):
                pick = min(found, key=lambda c: (-best[c], columns[c])) if lo == 0 else found[0]
                return float(best[pick]), int(columns[pick]), int(gain[pick].argmax())
        return None

    def sums(at: np.ndarray) -> np.ndarray:
        out = np.empty((3, wide, bins.width))
        step = max(1, SUM_ENTRIES // max(1, len(at)))
        for lo in range(0, wide, step):                            # some features at a time: the same sums, row by row
            codes = bins.codes[at, lo:lo + step]
            n = codes.shape[1]
            flat = (codes + np.arange(n) * bins.width).ravel()
            for s, v in enumerate((g, h, count)):
                out[s, lo:lo + n] = np.bincount(flat, np.repeat(v[at], n), n * bins.width).reshape(n, bins.width)
        return out

    def leaf(at: np.ndarray, hist: np.ndarray | None, depth: int) -> int:
        node, total_g, total_h = len(tree["value"]), g[at].sum(), h[at].sum()
        for k, v in (("feature", -1), ("edge", 0.0), ("left", 0), ("right", 0), ("gain", 0.0), ("code", 0)):
            tree[k].append(v)
        tree["value"].append(float(total_g / (total_h + limits.l2)) if total_h + limits.l2 else 0.0)
        members.append(at)
        if limits.max_depth is not None and depth >= limits.max_depth:
            return node
        if lazy:
            if (split := drawn_split(at, total_g, total_h)) is not None:
                heapq.heappush(waiting, (-split[0], node, split[1], split[2], depth, None))
        else:
            gain = gains(hist, total_g, total_h, allowed)
            best = gain.max(axis=1, initial=-np.inf)
            if limits.features is not None and limits.features < wide:      # look on while none of the drawn ones splits
                order = rng.permutation(wide)
                found = np.flatnonzero(best[order] > 1e-12)
                last = max(limits.features, found[0] + 1 if len(found) else 0)
                best[order[last:]] = -np.inf
            f = int(best.argmax()) if wide else 0
            if wide and best[f] > 1e-12:
                kept = hist if held[0] < HELD_HISTOGRAMS else None
                held[0] += kept is not None
                heapq.heappush(waiting, (-float(best[f]), node, f, int(gain[f].argmax()), depth, kept))
        return node

    leaf(rows, None if lazy else sums(rows), 0)
    leaves = 1
    while waiting and (limits.max_leaves is None or leaves < limits.max_leaves):
        gain, node, f, code, depth, hist = heapq.heappop(waiting)
        at = members[node]
        near = bins.codes[at, f] <= code
        a, b = at[near], at[~near]
        members[node] = None
        if lazy:
            halves = None, None
        elif hist is None:
            halves = sums(a), sums(b)
        else:
            held[0] -= 1
            small = sums(a if len(a) <= len(b) else b)
            halves = (small, hist - small) if len(a) <= len(b) else (hist - small, small)
        tree["feature"][node], tree["edge"][node], tree["gain"][node] = f, float(bins.edges[f][code]), -gain
        tree["left"][node], tree["right"][node] = leaf(a, halves[0], depth + 1), leaf(b, halves[1], depth + 1)
        tree["code"][node] = code
        leaves += 1
    return tree, _reach(tree, bins.codes)


def _reach(tree: dict, codes: np.ndarray) -> np.ndarray:
    feature, code, left, right = (np.array(tree[k]) for k in ("feature", "code", "left", "right"))
    at, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while (inner := feature[at] >= 0).any():
        near = codes[rows, np.maximum(feature[at], 0)] <= code[at]
        at = np.where(inner, np.where(near, left[at], right[at]), at)
    return np.array(tree["value"])[at]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: dict, seed: int) -> tuple[float, list[dict]]:
    """Log-odds of the weighted share of positives, and the trees; leaf values include the learning rate."""
    bins, rng = Bins(x), np.random.default_rng(seed)
    share = min(max(float((weight * y).sum() / weight.sum()), 1e-12), 1 - 1e-12)
    base, trees = float(np.log(share / (1 - share))), []
    margin, ones = np.full(len(y), base), np.ones(len(y))
    limits = Growth(params.get("max_leaf_nodes"), params.get("max_depth"), params.get("min_samples_leaf", 1),
                    params.get("min_child_weight", 1e-3), params.get("l2_regularization", 1.0))
    for _ in range(int(params["n_trees"])):
        p = 1 / (1 + np.exp(-margin))
        rows = np.arange(len(y))
        if params.get("subsample", 1.0) < 1:
            rows = np.flatnonzero(rng.random(len(y)) < params["subsample"])
        columns = None
        if params.get("colsample_bytree", 1.0) < 1:
            columns = rng.choice(x.shape[1], max(1, int(params["colsample_bytree"] * x.shape[1])), replace=False)
        tree, step = grow(bins, rows, weight * (y - p), weight * p * (1 - p), ones, limits, rng, columns)
        rate = float(params["learning_rate"])
        margin = margin + rate * step
        trees.append({**tree, "value": [v * rate for v in tree["value"]]})
    return base, trees


def drawn_features(share: str | float, wide: int) -> int:
    """How many of ``wide`` features a node draws."""
    return max(1, {"sqrt": int(wide ** 0.5), "log2": int(np.log2(max(wide, 1)))}[share] if isinstance(share, str) else int(share * wide))


def forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, copies: list[dict], trees: Iterator[int], params: dict, seed: int) -> list[dict]:
    """One tree a draw; ``copies`` of a row says how often each tree drew it."""
    bins, out = Bins(x), []
    limits = Growth(None, params.get("max_depth"), int(params.get("min_samples_leaf", 1)), features=drawn_features(params["max_features"], x.shape[1]))
    for t in trees:
        times = np.array([c.get(t, 0) for c in copies], dtype=float)
        rows = np.flatnonzero(times)
        if len(rows):
            tree, _ = grow(bins, rows, times * weight * y, times * weight, times, limits, np.random.default_rng([seed, t]))
            out.append(tree)
    return out


# ------------------------------------------------------------- Spark side
def balanced_draws(rows: DataFrame, n_trees: int, seed: int = SEED, y: str = "y", frame: str = "frame", id_col: str = "unit_id") -> DataFrame:
    """(frame, tree, id, copies): every tree draws, with replacement, as many rows of each class as the smallest
    class has. Draw j of a tree takes the row of seeded rank h60(tree:class:j:seed) % class size + 1."""
    ranked = seeded_rank(rows.select(frame, id_col, y), id_col, [frame, y], seed)
    sizes = rows.groupBy(frame, y).agg(F.count(F.lit(1)).alias("size"))
    least = sizes.groupBy(frame).agg(F.min("size").alias("least"))
    per_tree = sizes.join(least, frame).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    draws = per_tree.repartition(frame, y, "tree").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("least"))))
    name = F.concat_ws(":", F.col("tree").cast("string"), F.col(y).cast("int").cast("string"), F.col("j").cast("string"), F.lit(str(seed)))
    picked = draws.groupBy(frame, y, "tree", (h60(name) % F.col("size") + 1).alias("rank")).agg(F.count(F.lit(1)).alias("copies"))
    # the planner takes the draws for as few rows as there are before the explode, and would broadcast all of them
    return picked.hint("merge").join(ranked, [frame, y, "rank"]).select(frame, "tree", id_col, y, "copies")


def root_gains(rows: DataFrame, l2: float = 1.0, min_child_weight: float = 1e-3, bins: int = 32, y: str = "y", x: str = "features") -> DataFrame:
    """(feature, bin, gain): the first split's gain at every cut of ``bins`` equal-width bins of each feature, from one
    aggregation of gradients and hessians over all rows at the base margin. Cuts with too light a side are null."""
    from pyspark.sql import Window
    share = rows.agg(F.avg(F.col(y).cast("double")).alias("p"))
    long = rows.select(F.col(y).cast("double").alias("y"), F.posexplode(x).alias("feature", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    span = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = long.join(F.broadcast(span), "feature").withColumn(       # one row a feature
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int"))
    p = share.scalar()
    hist = placed.groupBy("feature", "bin").agg(F.sum(F.col("y") - p).alias("g"), F.sum(p * (1 - p)).alias("h"))
    upto = Window.partitionBy("feature").orderBy("bin")                # at most `bins` rows a feature
    every = Window.partitionBy("feature")
    both = hist.select("feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
                       F.sum("g").over(every).alias("gt"), F.sum("h").over(every).alias("ht"))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = F.col("gl") ** 2 / (F.col("hl") + l2) + gr ** 2 / (hr + l2) - F.col("gt") ** 2 / (F.col("ht") + l2)
    return both.select("feature", "bin", F.when((F.col("hl") >= min_child_weight) & (hr >= min_child_weight), gain).alias("gain"))


def bounded_sample(rows: DataFrame, max_rows: int = MAX_ROWS, frame: str = "frame", id_col: str = "unit_id", seed: int = SEED) -> DataFrame:
    """About ``max_rows`` rows of each frame that has more, by hash of the id; smaller frames whole. No fit is based on it."""
    sizes = rows.groupBy(frame).agg(F.count(F.lit(1)).alias("_size"))       # one row a frame
    key = h32(F.concat(F.col(id_col).cast("string"), F.lit(f":sample:{seed}")))
    return rows.join(F.broadcast(sizes), frame).where(key * F.col("_size") < F.lit(max_rows) * F.lit(1 << 32)).drop("_size")


def fit_trees(rows: DataFrame, models: list[dict], seed: int = SEED, max_rows: int = MAX_ROWS, y: str = "y") -> list[TreeEnsemble]:
    """One ensemble per entry of ``models`` ({frame, estimator, params, weights}), grown together from all of
    ``rows`` (frame, unit_id, y, features); frames of over ``max_rows`` rows are not gathered in a task."""
    rows = rows.select("frame", "unit_id", F.col(y).cast("int").alias("y"), "features")
    large = {r["frame"] for r in rows.groupBy("frame").count().where(F.col("count") > max_rows).collect()}     # a row a frame
    if not large:
        return _fit_gathered(rows, models, seed)
    from .spread_trees import fit_spread
    out: list = [None] * len(models)
    for fit, mine, among in ((fit_spread, [m for m, spec in enumerate(models) if spec["frame"] in large], F.col("frame").isin(sorted(large))),
                             (_fit_gathered, [m for m, spec in enumerate(models) if spec["frame"] not in large], ~F.col("frame").isin(sorted(large)))):
        if mine:
            more = (max_rows,) if fit is fit_spread else ()
            for m, fitted in zip(mine, fit(rows.where(among), [models[m] for m in mine], seed, *more)):
                out[m] = fitted
    return out


def _fit_gathered(rows: DataFrame, models: list[dict], seed: int) -> list[TreeEnsemble]:
    """Frames that one task holds, all models in one job."""
    spark = rows.sparkSession
    whole, parts, frames = [], [], {}
    for m, spec in enumerate(models):
        if spec["estimator"] == "balanced_rf":
            n = int(spec["params"]["n_estimators"])
            frames[spec["frame"]] = max(n, frames.get(spec["frame"], 0))
            for t in range(0, n, TREES_A_TASK):
                parts.append((m, t, min(n, t + TREES_A_TASK)))
        else:
            whole.append((m, spec["frame"]))
    tasks, inputs = {}, []
    if whole:
        tasks.update({m: (m, 0, 0) for m, _ in whole})
        keyed = spark.createDataFrame(whole, "task int, frame int")
        inputs.append(rows.join(F.broadcast(keyed), "frame").select("task", "y", "features", F.lit(None).cast("map<int,bigint>").alias("copies")))
    if frames:
        first = len(models)
        listed = []
        for m, lo, hi in parts:
            tasks[first] = (m, lo, hi)
            listed.append((first, models[m]["frame"], lo // TREES_A_TASK))
            first += 1
        drawn = balanced_draws(rows.where(F.col("frame").isin(list(frames))), max(frames.values()), seed)
        drawn = drawn.groupBy("frame", "unit_id", F.floor(F.col("tree") / TREES_A_TASK).cast("int").alias("part")).agg(
            F.map_from_entries(F.collect_list(F.struct("tree", "copies"))).alias("copies"))
        keyed = spark.createDataFrame(listed, "task int, frame int, part int")
        inputs.append(drawn.join(F.broadcast(keyed), ["frame", "part"]).join(rows, ["frame", "unit_id"]).select("task", "y", "features", "copies"))
    every = inputs[0] if len(inputs) == 1 else inputs[0].unionByName(inputs[1])

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        m, lo, hi = tasks[int(key[0])]
        spec = models[m]
        x, target = np.stack(group["features"]).astype(float), group["y"].to_numpy().astype(float)
        order = np.lexsort([*x.T[:8], target])                        # the same trees whatever the order of rows
        x, target = x[order], target[order]
        weight = np.array([spec["weights"].get(int(v), 1.0) for v in target])
        if spec["estimator"] == "balanced_rf":
            copies = [dict(c) for c in group["copies"].iloc[order]]
            grown, trees = TreeEnsemble(False, 0.0), forest(x, target, weight, copies, range(lo, hi), spec["params"], seed)
        else:
            base, trees = boost(x, target, weight, spec["params"], seed)
            grown = TreeEnsemble(True, base)
        for tree in trees:
            grown.add(tree)
        return pd.DataFrame({"model": [m], "first": [lo], "state": [pickle.dumps(grown)]})

    grown = cut_lineage(every.repartition(max(1, len(tasks)), "task").groupBy("task").applyInPandas(fit, "model int, first int, state binary"))
    done: dict[int, dict[int, bytes]] = {}
    out = [TreeEnsemble(spec["estimator"] != "balanced_rf", 0.0) for spec in models]
    for r in grown.toLocalIterator():                                  # some models' trees at a time pass through the driver
        done.setdefault(r["model"], {})[r["first"]] = bytes(r["state"])
    for m, states in done.items():                                     # bounded by models x trees x leaves
        for first in sorted(states):
            part = pickle.loads(states.pop(first))
            out[m].base = part.base
            out[m].append(part)
    return out

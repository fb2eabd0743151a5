"""Wafer-map operators: per-wafer summaries, filters, and the windowed
yield-versus-area curve.

Window counting (``count_windows``) has two physical forms with equal results:

* ``method="kernel"`` (default) — ``mapInArrow`` over Arrow batches: wafers of
  one shape are stacked into a numpy cube and every w x w block is tested at
  once; each task emits only per-(group, window) partial counts, so the
  shuffle that follows carries a handful of rows per task.
* ``method="cells"`` — pure DataFrame form over the long ``cells`` table
  (block id = r div w, c div w). Kept as the declarative reference; about an
  order of magnitude slower on wide data.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.arrays import count_where, normalize_cells, resize_nearest, dihedral
from ..functions.hashing import seeded_key
from ..functions.labels import CNN_UNLABELED, flatten_label

NO_DIE, GOOD_DIE, BAD_DIE = 0, 1, 2
# Default extraction settings.
WINDOW_SIZES = (1, 2, 3, 4, 5, 6, 7, 8)
MIN_WINDOWS_PER_AREA = 30
MIN_DIE_COUNT = 100


# ----------------------------------------------------------------- projections
def with_summary(wafers: DataFrame) -> DataFrame:
    """PRJ-04: ``n_die`` (cells != 0), ``n_bad`` (cells == 2), ``defect_rate``
    (NULL when the map has no die)."""
    return (wafers
            .withColumn("n_die", count_where("cells", lambda x: x != NO_DIE).cast("long"))
            .withColumn("n_bad", count_where("cells", lambda x: x == BAD_DIE).cast("long"))
            .withColumn("defect_rate", F.try_divide(F.col("n_bad").cast("double"), F.col("n_die"))))


def with_labels(wafers: DataFrame, raw_col: str = "failure_raw", token: str = CNN_UNLABELED,
                out: str = "label") -> DataFrame:
    """PRJ-01/02: flatten nested labels; a missing column gives all-unlabeled."""
    if raw_col not in wafers.columns:
        return wafers.withColumn(out, F.lit(token))
    return wafers.withColumn(out, flatten_label(raw_col, token))


def dims(wafers: DataFrame) -> DataFrame:
    """PRJ-05: map dimensions of true 2-D maps (rows*cols must equal the cell count)."""
    return (wafers.filter(F.size("cells") == F.col("rows") * F.col("cols"))
            .select("wafer_id", "rows", "cols"))


def resized(wafers: DataFrame, size: int, via: str | None = None) -> DataFrame:
    """PRJ-06 + PRJ-07: nearest-neighbour resize then scale to [0, 1] floats. ``via``: a column with a size that the
    map is brought to before (null: none)."""
    between = None if via is None else F.col(via)
    return wafers.withColumn("x", normalize_cells(resize_nearest("cells", "rows", "cols", size, between)))


def augment(wafers: DataFrame, size: int, all_variants: bool = False, seed: int = 42) -> DataFrame:
    """PRJ-09 (re-aimed): dihedral augmentation of square ``size x size`` maps.

    ``all_variants`` emits all 8 symmetries per map (a bounded 8x multiplier);
    otherwise one hash-chosen variant per map (deterministic for a seed)."""
    if all_variants:
        out = wafers.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(7))))
    else:
        out = wafers.withColumn("variant", (seeded_key("wafer_id", seed) % 8).cast("int"))
    return out.withColumn("cells", dihedral("cells", size, F.col("variant")))


# ---------------------------------------------------------------------- filters
def filter_wafers(wafers: DataFrame, min_die_count: int = MIN_DIE_COUNT,
                  failure_types: list[str] | None = None, label_col: str = "label") -> DataFrame:
    """FLT-01: keep maps with at least ``min_die_count`` dies and, optionally,
    one of the given failure types (a literal IN list; Catalyst turns it into
    an InSet, no join needed)."""
    cond = count_where("cells", lambda x: x != NO_DIE) >= min_die_count
    if failure_types:
        cond = cond & F.col(label_col).isin(list(failure_types))
    return wafers.filter(cond)


def cap_wafers(wafers: DataFrame, max_wafers: int | None, seed: int = 42) -> DataFrame:
    """FLT-02: seeded exact cap — the ``max_wafers`` rows with the smallest
    hash(id, seed). A top-k: Spark plans it as TakeOrderedAndProject (per-task
    top-k, then a k-row merge), never a full sort."""
    if max_wafers is None:
        return wafers
    return (wafers.withColumn("_k", seeded_key("wafer_id", seed))
            .orderBy("_k", "wafer_id").limit(max_wafers).drop("_k"))


def filter_labeled(df: DataFrame, drop_none: bool = True, label_col: str = "label",
                   token: str = CNN_UNLABELED) -> DataFrame:
    """FLT-03: drop unlabeled rows and, optionally, the 'none' class (case-insensitive)."""
    cond = F.col(label_col) != token
    if drop_none:
        cond = cond & (F.lower(F.col(label_col)) != "none")
    return df.filter(cond)


# ------------------------------------------------------------ window counting
def _counts_for_cube(cube: np.ndarray, w: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """cube: (n, H, W) int8 -> per-wafer (n_valid, n_yield) for window w."""
    n, h, wd = cube.shape
    if h < w or wd < w:
        z = np.zeros(n, dtype=np.int64)
        return z, z
    if stride == w:
        nr, nc = h // w, wd // w
        blk = cube[:, :nr * w, :nc * w].reshape(n, nr, w, nc, w)
        nodie = (blk == NO_DIE).any(axis=(2, 4))
        bad = (blk == BAD_DIE).any(axis=(2, 4))
    else:
        view = np.lib.stride_tricks.sliding_window_view(cube, (w, w), axis=(1, 2))[:, ::stride, ::stride]
        nodie = (view == NO_DIE).any(axis=(3, 4))
        bad = (view == BAD_DIE).any(axis=(3, 4))
    valid = ~nodie
    return valid.sum(axis=(1, 2)), (valid & ~bad).sum(axis=(1, 2))


def _window_kernel(group_cols: list[str], sizes: tuple[int, ...], stride: int | None,
                   arrow_schema: pa.Schema):
    def run(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            cells = rb.column("cells")
            offsets = cells.offsets.to_numpy()
            flat = cells.values.to_numpy(zero_copy_only=False).astype(np.int8, copy=False)
            rows = rb.column("rows").to_numpy(zero_copy_only=False)
            cols = rb.column("cols").to_numpy(zero_copy_only=False)
            # group index per row (distinct group keys within this batch)
            if group_cols:
                keys = list(zip(*[rb.column(g).to_pylist() for g in group_cols]))
                uniq = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                gidx = np.fromiter((uniq[k] for k in keys), dtype=np.int64, count=len(keys))
                key_list = list(uniq)
            else:
                gidx = np.zeros(rb.num_rows, dtype=np.int64)
                key_list = [()]
            ng = len(key_list)
            acc_v = {w: np.zeros(ng, dtype=np.int64) for w in sizes}
            acc_y = {w: np.zeros(ng, dtype=np.int64) for w in sizes}
            shapes = np.stack([rows, cols], axis=1)
            for (h, wd) in {tuple(s) for s in shapes.tolist()}:
                sel = np.nonzero((rows == h) & (cols == wd))[0]
                if h * wd == 0:
                    continue
                starts = offsets[sel]
                idx = starts[:, None] + np.arange(h * wd)[None, :]
                cube = flat[idx].reshape(len(sel), h, wd)
                for w in sizes:
                    v, y = _counts_for_cube(cube, w, stride or w)
                    np.add.at(acc_v[w], gidx[sel], v)
                    np.add.at(acc_y[w], gidx[sel], y)
            out = {g: [k[i] for k in key_list for _ in sizes] for i, g in enumerate(group_cols)}
            out["window"] = [w for _ in key_list for w in sizes]
            out["n_valid"] = [int(acc_v[w][gi]) for gi in range(ng) for w in sizes]
            out["n_yield"] = [int(acc_y[w][gi]) for gi in range(ng) for w in sizes]
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)
    return run


def count_windows(wafers: DataFrame, sizes: tuple[int, ...] = WINDOW_SIZES, stride: int | None = None,
                  group_cols: list[str] | tuple[str, ...] = (), method: str = "kernel") -> DataFrame:
    """WAF-01/02: valid and yielding w x w windows summed per (group, window).

    A window is VALID when it holds no 0 cell and YIELDING when it is valid and
    holds no 2 cell. Windows start at (0, 0) with step ``stride`` (default w,
    i.e. non-overlapping tiling) and must lie fully inside the map; a map
    smaller than w contributes nothing.
    """
    group_cols = list(group_cols)
    if method == "kernel":
        out_schema = T.StructType(list(wafers.select(*group_cols).schema.fields) + [
            T.StructField("window", T.IntegerType()), T.StructField("n_valid", T.LongType()),
            T.StructField("n_yield", T.LongType())])
        kernel = _window_kernel(group_cols, tuple(sizes), stride, to_arrow_schema(out_schema))
        # the kernel reads rows * cols cells from a map's offset: malformed maps stay out
        whole = wafers.filter((F.col("rows") >= 0) & (F.col("cols") >= 0)
                              & (F.size("cells") == F.col("rows").cast("long") * F.col("cols"))
                              & ~F.exists("cells", lambda c: c.isNull()))
        part = (whole.select(*group_cols, "rows", "cols", "cells")
                .mapInArrow(kernel, out_schema))
    elif method == "cells":
        part = _count_windows_cells(wafers, sizes, stride, group_cols)
    else:
        raise ValueError(f"unknown method {method!r}")
    return (part.groupBy(*group_cols, "window")
            .agg(F.sum("n_valid").cast("long").alias("n_valid"),
                 F.sum("n_yield").cast("long").alias("n_yield")))


def _count_windows_cells(wafers: DataFrame, sizes, stride, group_cols) -> DataFrame:
    """Declarative form: explode cells, assign each cell to the window origins
    covering it, aggregate per window, then per (group, w)."""
    sizes_arr = F.array(*[F.lit(int(w)) for w in sizes])
    cells = (wafers.select(*group_cols, "wafer_id", "rows", "cols", F.posexplode("cells").alias("k", "cell"))
             .withColumn("r", F.floor(F.col("k") / F.col("cols")).cast("int"))
             .withColumn("c", (F.col("k") % F.col("cols")).cast("int"))
             .withColumn("window", F.explode(sizes_arr)))
    w = F.col("window")
    s = F.lit(stride) if stride else w
    if stride:
        # every origin (i*s, j*s) with origin <= coordinate < origin + w
        def origins(x):
            lo = F.greatest(F.ceil((x - w + 1) / s), F.lit(0)).cast("int")
            hi = F.floor(x / s).cast("int")
            return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        cells = (cells.withColumn("bi", F.explode(origins(F.col("r"))))
                 .withColumn("bj", F.explode(origins(F.col("c")))))
    else:
        cells = cells.withColumn("bi", F.floor(F.col("r") / w)).withColumn("bj", F.floor(F.col("c") / w))
    inside = ((F.col("bi") * s + w <= F.col("rows")) & (F.col("bj") * s + w <= F.col("cols")))
    blocks = (cells.filter(inside)
              .groupBy(*group_cols, "wafer_id", "window", "bi", "bj")
              .agg(F.max((F.col("cell") == NO_DIE).cast("int")).alias("has0"),
                   F.max((F.col("cell") == BAD_DIE).cast("int")).alias("has2")))
    return blocks.select(*group_cols, "window",
                         (F.col("has0") == 0).cast("long").alias("n_valid"),
                         ((F.col("has0") == 0) & (F.col("has2") == 0)).cast("long").alias("n_yield"))


def yield_curve(wafers: DataFrame, sizes: tuple[int, ...] = WINDOW_SIZES, stride: int | None = None,
                min_windows: int = MIN_WINDOWS_PER_AREA, group_cols: list[str] | tuple[str, ...] = (),
                method: str = "kernel") -> DataFrame:
    """WAF-03/05/06 + FLT-06: pooled curve ``(group..., window, area, yield, n_valid, n_yield)``;
    points with fewer than ``min_windows`` valid windows are dropped."""
    c = count_windows(wafers, sizes, stride, group_cols, method)
    return (c.filter(F.col("n_valid") >= min_windows)
            .select(*group_cols, F.col("window").cast("int").alias("window"),
                    (F.col("window") * F.col("window")).cast("double").alias("area"),
                    (F.col("n_yield") / F.col("n_valid")).alias("yield"),
                    "n_valid", "n_yield"))


def require_points(curve: DataFrame) -> DataFrame:
    """FLT-06 error path: raise when no area point survived (the curve is tiny)."""
    if curve.limit(1).count() == 0:
        raise ValueError("the curve is empty: every window size has fewer valid windows than the limit asks for")
    return curve


def point_weights(y: Column | str = "yield", n: Column | str = "n_valid") -> Column:
    """WAF-04: 1/sigma with p clipped to [1e-6, 1-1e-6] and sigma floored at 1e-4."""
    y = F.col(y) if isinstance(y, str) else y
    n = F.col(n) if isinstance(n, str) else n
    p = F.least(F.greatest(y, F.lit(1e-6)), F.lit(1 - 1e-6))
    sigma = F.greatest(F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1))), F.lit(1e-4))
    return 1.0 / sigma

"""Lifecycle A: wafer maps -> curve -> fits -> leaderboard -> bundle -> answers.

Everything stays lazy until the curve, which is a few rows per group; the
curve is cached before the fits so the window job runs once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import wafer as W
from ..operators import yieldfit as YF
from ..sinks import bundle as B
from ..sources import fixtures as FX


def wafer_curve(spark: SparkSession, sf_dir: str, group_cols=(), failure_types=None,
                min_die_count: int = W.MIN_DIE_COUNT, max_wafers: int | None = None,
                sizes=W.WINDOW_SIZES, stride=None, min_windows=W.MIN_WINDOWS_PER_AREA) -> DataFrame:
    wf = FX.wafers(spark, sf_dir)
    if failure_types or "label" in group_cols:
        wf = W.with_labels(wf.join(FX.raw_labels(spark, sf_dir), "wafer_id", "left"))
    wf = W.filter_wafers(wf, min_die_count, failure_types)
    wf = W.cap_wafers(wf, max_wafers)
    return W.yield_curve(wf, sizes, stride, min_windows, group_cols)


def train(curve: DataFrame, group_cols=(), method: str = "lm"):
    """Fit all models, score and rank. Returns (fits, leaderboard)."""
    fits = YF.fit_lm(curve, group_cols) if method == "lm" else YF.fit_grid(curve, group_cols)
    board = YF.leaderboard(YF.score(curve, fits, group_cols), group_cols)
    return fits, board


def leaderboard_for(spark: SparkSession, sf_dir: str, group_cols=()) -> DataFrame:
    curve = wafer_curve(spark, sf_dir, group_cols).cache()
    _, board = train(curve, group_cols)
    return board


def train_bundle(spark: SparkSession, sf_dir: str, group_cols=(), ref_die_area_mm2: float = 1.0,
                 method: str = "lm") -> DataFrame:
    curve = wafer_curve(spark, sf_dir, group_cols).cache()
    fits, board = train(curve, group_cols, method)
    joined = YF.fits_with_scores(fits, board, group_cols)
    return B.build_bundle(joined, group_cols, ref_die_area_mm2, {"method": method})

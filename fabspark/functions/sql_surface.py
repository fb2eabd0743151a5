"""The engine's functions for SQL users: the yield models as SQL functions and window counting as a table function.

``register(spark)`` defines, for the session:

* ``poisson_yield(area, d0)``, ``murphy_yield(area, d0)``, ``negative_binomial_yield(area, d0, alpha)`` and
  ``model_yield(model, area, d0, alpha)``: SQL functions whose bodies Catalyst inlines; a null argument that a
  model needs gives null, an unknown model too;
* ``die_windows(cells, map_rows, map_cols, sizes)``: one row (die_window, n_valid, n_yield) a window size of a wafer map, for
  ``LATERAL`` joins. Null and malformed maps (cell count not rows x cols, null cells) give no row, as in ``count_windows``.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .yieldmodels import MURPHY_EPS

_SCALAR = (
    "poisson_yield(area DOUBLE, d0 DOUBLE) RETURNS DOUBLE RETURN exp(-d0 * area)",
    f"""murphy_yield(area DOUBLE, d0 DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN d0 * area > {MURPHY_EPS!r} THEN pow((1 - exp(-d0 * area)) / nullif(d0 * area, 0), 2)
                    WHEN d0 * area IS NOT NULL THEN 1D END""",
    """negative_binomial_yield(area DOUBLE, d0 DOUBLE, alpha DOUBLE) RETURNS DOUBLE
       RETURN pow(1 + d0 * area / nullif(alpha, 0), -alpha)""",
    """model_yield(model STRING, area DOUBLE, d0 DOUBLE, alpha DOUBLE) RETURNS DOUBLE
       RETURN CASE model WHEN 'poisson' THEN poisson_yield(area, d0) WHEN 'murphy' THEN murphy_yield(area, d0)
                         WHEN 'negative_binomial' THEN negative_binomial_yield(area, d0, alpha) END""",
)


class _DieWindows:
    def eval(self, cells, map_rows, map_cols, sizes):
        from ..operators.wafer import _counts_for_cube
        if cells is None or sizes is None or map_rows is None or map_cols is None or min(map_rows, map_cols) < 1:
            return
        if len(cells) != map_rows * map_cols or any(c is None for c in cells):
            return
        cube = np.asarray(cells, dtype=np.int8).reshape(1, map_rows, map_cols)
        for w in sizes:
            valid, good = _counts_for_cube(cube, w, w)
            yield int(w), int(valid[0]), int(good[0])


def register(spark: SparkSession) -> None:
    for body in _SCALAR:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    spark.udtf.register("die_windows", udtf(_DieWindows, returnType="die_window int, n_valid bigint, n_yield bigint"))

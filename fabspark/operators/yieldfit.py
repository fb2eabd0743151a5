"""Fitting, scoring and ranking yield models on yield-versus-area curves.

A curve is ``(group..., window, area, yield, n_valid, n_yield)`` with a
handful of points per group. Two fitters, both grouped so thousands of
curves (per lot, per failure type) fit in one job:

* ``fit_lm``   — weighted nonlinear least squares (Levenberg–Marquardt in
  log-parameters with the reference's bounds), one pandas call per group via
  ``applyInPandas``; each group holds only its curve points.
* ``fit_grid`` — exhaustive search over a fixed log-spaced parameter grid in
  plain DataFrame operations (points array + generator + minimum); its result
  can be checked by SQL.

Fits are ``(group..., model, d0, alpha, success, message)``; ``alpha`` is
NULL for one-parameter models.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import yieldmodels as YM
from .wafer import point_weights

# Default search grid (log10 ranges and step counts).
D0_GRID = (-4.0, 0.0, 400)        # D0 = 10^(-4 .. 0), 401 points
ALPHA_GRID = (-2.0, 3.0, 100)     # alpha = 10^(-2 .. 3), 101 points


def _model_list(models) -> list[str]:
    names = list(models or YM.MODEL_ORDER)
    for n in names:
        YM.get_model(n)          # JON-03: unknown names raise
    return names


# --------------------------------------------------------------- grid search
def _grid_values(lo: float, hi: float, n: int, idx):
    return F.pow(F.lit(10.0), F.lit(lo) + idx * ((hi - lo) / n))


def fit_grid(curve: DataFrame, group_cols=(), models=None, d0_grid=D0_GRID, alpha_grid=ALPHA_GRID) -> DataFrame:
    """MDL-06: weighted least squares over a fixed log-spaced grid, best point
    per (group, model).

    A group's few curve points (one a window size) become one array; the grid (a fixed
    multiplier, ~41k) is then expanded once a group and the weighted loss summed over
    the array in place, so no grid row is shuffled: each task keeps the minimum of
    its rows, with a deterministic tie-break (smallest i, then j)."""
    group_cols = list(group_cols)
    names = _model_list(models)
    lo, hi, n = d0_grid
    alo, ahi, an = alpha_grid
    two = [m for m in names if YM.get_model(m).n_params == 2]
    point = F.struct("area", "yield", (point_weights() ** 2).alias("w2"))
    groups = curve.groupBy(*group_cols).agg(F.sort_array(F.collect_list(point)).alias("points")).where(F.size("points") > 0)

    grid = (groups.withColumn("model", F.explode(F.array(*[F.lit(m) for m in names])))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
            .withColumn("j", F.explode(F.when(F.col("model").isin(two), F.sequence(F.lit(0), F.lit(an)))
                                       .otherwise(F.array(F.lit(None).cast("int")))))
            .withColumn("d0", _grid_values(lo, hi, n, F.col("i")))
            .withColumn("alpha", F.when(F.col("j").isNotNull(), _grid_values(alo, ahi, an, F.col("j")))))

    def added(total, p):
        pred = YM.yield_by_name(F.col("model"), p["area"], F.col("d0"), F.col("alpha"))
        return total + F.coalesce(p["w2"] * (p["yield"] - pred) ** 2, F.lit(0.0))

    loss = grid.withColumn("loss", F.aggregate("points", F.lit(0.0), added))
    best = (loss.groupBy(*group_cols, "model")
            .agg(F.min(F.struct("loss", "i", F.coalesce("j", F.lit(-1)).alias("j"), "d0", "alpha")).alias("b")))
    return best.select(*group_cols, "model", F.col("b.d0").alias("d0"), F.col("b.alpha").alias("alpha"),
                       F.col("b.loss").alias("loss"), F.lit(True).alias("success"),
                       F.lit("grid minimum").alias("message"))


# ------------------------------------------------------------------- LM fit
def _predict_np(name: str, area: np.ndarray, th: np.ndarray) -> np.ndarray:
    d0 = th[0]
    if name == "poisson":
        return np.exp(-d0 * area)
    if name == "murphy":
        lam = d0 * area
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(lam > YM.MURPHY_EPS, (1.0 - np.exp(-lam)) / lam, 1.0)
        return g * g
    a = th[1]
    return np.power(1.0 + d0 * area / a, -a)


def _jac_np(name: str, area: np.ndarray, th: np.ndarray) -> np.ndarray:
    """d prediction / d parameters, shape (n, k)."""
    d0 = th[0]
    if name == "poisson":
        return (-area * np.exp(-d0 * area))[:, None]
    if name == "murphy":
        lam = d0 * area
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.exp(-lam)
            g = np.where(lam > YM.MURPHY_EPS, (1.0 - e) / lam, 1.0)
            dg = np.where(lam > YM.MURPHY_EPS, (e * (lam + 1.0) - 1.0) / (lam * lam), -0.5)
        return (2.0 * g * dg * area)[:, None]
    a = th[1]
    u = 1.0 + d0 * area / a
    f = np.power(u, -a)
    dd0 = -area * f / u
    da = f * (-np.log(u) + (d0 * area / a) / u)
    return np.stack([dd0, da], axis=1)


def lm_fit(name: str, area: np.ndarray, y: np.ndarray, sigma: np.ndarray,
           p0: tuple[float, ...], bounds: tuple[tuple[float, float], ...],
           max_iter: int = 500) -> tuple[np.ndarray, np.ndarray | None, bool, str]:
    """Weighted LM in log-parameters with clamping to bounds.

    Returns (params, covariance (J^T W J)^-1 with absolute sigma, success, message)."""
    lo = np.log(np.array([max(b[0], 1e-300) for b in bounds]))
    hi = np.log(np.array([b[1] if math.isfinite(b[1]) else 1e300 for b in bounds]))
    phi = np.clip(np.log(np.array(p0, dtype=float)), lo, hi)

    def cost(ph):
        r = (y - _predict_np(name, area, np.exp(ph))) / sigma
        return float(r @ r), r
    c, r = cost(phi)
    lam = 1e-3
    if not np.isfinite(c):
        return np.full(len(p0), np.nan), None, False, "not fitted: the first cost is not finite"
    for _ in range(max_iter):
        th = np.exp(phi)
        J = _jac_np(name, area, th) * th[None, :] / sigma[:, None]
        A = J.T @ J
        g = J.T @ r
        improved = False
        while lam < 1e16:
            step = np.linalg.lstsq(A + lam * np.diag(np.maximum(np.diag(A), 1e-30)), g, rcond=None)[0]
            cand = np.clip(phi + step, lo, hi)
            c2, r2 = cost(cand)
            if np.isfinite(c2) and c2 <= c:
                improved = True
                break
            lam *= 10.0
        if not improved:
            break
        rel = (c - c2) / max(c, 1e-300)
        move = np.max(np.abs(cand - phi))
        phi, c, r = cand, c2, r2
        lam = max(lam / 10.0, 1e-12)
        if rel < 1e-14 and move < 1e-10:
            break
    th = np.exp(phi)
    Jt = _jac_np(name, area, th) / sigma[:, None]
    try:
        cov = np.linalg.pinv(Jt.T @ Jt)
    except np.linalg.LinAlgError:
        cov = None
    if not np.all(np.isfinite(th)):
        return np.full(len(p0), np.nan), None, False, "not fitted: the parameters are not finite"
    return th, cov, True, "converged"


FIT_SCHEMA_FIELDS = [
    T.StructField("model", T.StringType()), T.StructField("d0", T.DoubleType()),
    T.StructField("alpha", T.DoubleType()), T.StructField("cov", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("success", T.BooleanType()), T.StructField("message", T.StringType()),
]


def fit_lm(curve: DataFrame, group_cols=(), models=None, d0_init: float = YM.D0_INIT,
           alpha_init: float = YM.ALPHA_INIT) -> DataFrame:
    """MDL-05/07/08: every model fit per group with weighted LM; failures give
    NaN-free NULL params, ``success = false`` and the error message."""
    group_cols = list(group_cols)
    names = _model_list(models)
    pts = curve.select(*group_cols, "area", "yield", (1.0 / point_weights()).alias("sigma"))
    gschema = pts.select(*group_cols).schema.fields
    schema = T.StructType(list(gschema) + FIT_SCHEMA_FIELDS)

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("area")
        area = pdf["area"].to_numpy(float)
        y = pdf["yield"].to_numpy(float)
        sigma = pdf["sigma"].to_numpy(float)
        out = []
        for name in names:
            m = YM.get_model(name)
            p0 = (d0_init,) if m.n_params == 1 else (d0_init, alpha_init)
            try:
                th, cov, ok, msg = lm_fit(name, area, y, sigma, p0, m.bounds)
            except Exception as exc:  # noqa: BLE001 — report, don't crash the job
                th, cov, ok, msg = np.full(m.n_params, np.nan), None, False, f"not fitted: {exc}"
            row = {g: pdf[g].iloc[0] for g in group_cols}
            row.update(model=name, d0=float(th[0]) if ok else None,
                       alpha=(float(th[1]) if ok else None) if m.n_params == 2 else None,
                       cov=cov.tolist() if cov is not None else None, success=ok, message=msg)
            out.append(row)
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    if group_cols:
        return pts.groupBy(*group_cols).applyInPandas(per_group, schema)
    # one global curve: still a grouped call on a constant key (the curve is tiny)
    return (pts.withColumn("_g", F.lit(0)).groupBy("_g")
            .applyInPandas(lambda pdf: per_group(pdf.drop(columns=["_g"])), schema))


# ------------------------------------------------------- bounded parameters
MAX_PARAM_ROWS = 64


def collect_params(params: DataFrame) -> list[tuple[str, float | None, float | None]]:
    """The per-model parameter rows of ONE bundle/fit (one row per model), size
    checked before anything reaches the driver."""
    rows = params.select("model", "d0", "alpha").limit(MAX_PARAM_ROWS + 1).collect()
    if len(rows) > MAX_PARAM_ROWS:
        raise ValueError(f"expected at most {MAX_PARAM_ROWS} model rows, got more; "
                         "use the grouped form (join on group keys) instead")
    return [(r["model"], r["d0"], r["alpha"]) for r in rows]


def attach_params(df: DataFrame, params) -> DataFrame:
    """Attach every (model, d0, alpha) to every row via a literal array +
    explode: a multiplier equal to the number of models, no join."""
    if isinstance(params, DataFrame):
        params = collect_params(params)
    lit = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(d).cast("double").alias("d0"),
                             F.lit(a).cast("double").alias("alpha")) for m, d, a in params])
    return df.withColumn("_p", F.explode(lit)).select("*", "_p.model", "_p.d0", "_p.alpha").drop("_p")


# ----------------------------------------------------------------- scoring
def score(curve: DataFrame, fits: DataFrame, group_cols=()) -> DataFrame:
    """MDL-09: rss, rmse, weighted rmse (weights 1/sigma^2), R^2 (NULL when the
    curve is flat), AIC/BIC with rss floored at 1e-12. Failed fits are dropped."""
    group_cols = list(group_cols)
    ok = fits.filter(F.col("success")).select(*group_cols, "model", "d0", "alpha")
    pts = curve.select(*group_cols, "area", "yield", (point_weights() ** 2).alias("w"))
    j = pts.join(ok, group_cols, "inner") if group_cols else attach_params(pts, ok)
    resid = F.col("yield") - YM.yield_by_name(F.col("model"), F.col("area"), F.col("d0"), F.col("alpha"))
    k = F.when(F.col("model") == "negative_binomial", 2).otherwise(1)
    agg = (j.withColumn("r", resid).withColumn("k", k)
           .groupBy(*group_cols, "model", "d0", "alpha", "k")
           .agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rss"),
                F.sum(F.col("w") * F.col("r") * F.col("r")).alias("wrss"), F.sum("w").alias("wsum"),
                (F.var_pop("yield") * F.count("*")).alias("ss_tot")))
    rss_safe = F.greatest(F.col("rss"), F.lit(1e-12))
    return agg.select(
        *group_cols, "model", F.col("k").alias("n_params"), "d0", "alpha", "rss",
        F.sqrt(F.col("rss") / F.col("n")).alias("rmse"),
        F.sqrt(F.col("wrss") / F.col("wsum")).alias("weighted_rmse"),
        F.when(F.col("ss_tot") > 0, 1.0 - F.col("rss") / F.when(F.col("ss_tot") > 0, F.col("ss_tot"))).alias("r2"),
        (F.col("n") * F.log(rss_safe / F.col("n")) + 2 * F.col("k")).alias("aic"),
        (F.col("n") * F.log(rss_safe / F.col("n")) + F.col("k") * F.log(F.col("n").cast("double"))).alias("bic"))


def leaderboard(scores: DataFrame, group_cols=()) -> DataFrame:
    """MDL-10 / WIN-02: rank 1..n per group by AIC, ties by weighted RMSE (then name).
    Without groups the window holds one row per model (<= 3 rows)."""
    order = ["aic", "weighted_rmse", "model"]
    w = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w))


def best_models(board: DataFrame, group_cols=()) -> DataFrame:
    return board.filter(F.col("rank") == 1).select(*group_cols, "model", "d0", "alpha")


def fits_with_scores(fits: DataFrame, scores: DataFrame, group_cols=()) -> DataFrame:
    """JON-02: every fit with its scores; failed fits keep NULL scores."""
    keys = list(group_cols) + ["model"]
    return fits.join(scores.drop("d0", "alpha"), keys, "left")


def unknown_models(requested: DataFrame, model_col: str = "model") -> DataFrame:
    """JON-03 anti side: requested model names the registry does not know
    (an IN-list over the registry, which lives on the driver)."""
    return requested.filter(~F.col(model_col).isin(list(YM.MODELS)))


# -------------------------------------------------------------- prediction
def forward(areas: DataFrame, params, area_col: str = "area", scale: float = 1.0) -> DataFrame:
    """MDL-11/12: yield for every (area row, model) pair of one bundle."""
    a = F.col(area_col) / scale
    return (attach_params(areas, params)
            .withColumn("yield", YM.yield_by_name(F.col("model"), a, F.col("d0"), F.col("alpha"))))


def inverse(targets: DataFrame, params, target_col: str = "target", scale: float = 1.0) -> DataFrame:
    """MDL-13/14: largest area reaching the target yield per model (x ``scale``
    for mm^2); NULL outside (0, 1), +inf when beyond the search bound."""
    return (attach_params(targets, params)
            .withColumn("max_area", YM.inverse_by_name(F.col("model"), F.col(target_col), F.col("d0"),
                                                       F.col("alpha")) * scale))


def linspace_grid(bounds: DataFrame, n: int = 200) -> DataFrame:
    """MDL-15: ``n`` evenly spaced areas between ``lo`` and ``hi`` of a one-row
    bounds frame (per group if it has group columns)."""
    return (bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("area", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (n - 1)))


# ------------------------------------------------------------- covariance
def _jacobian_cols(area, d0, alpha, model):
    """(d/dD0, d/dalpha) of the model prediction as Column expressions."""
    lam = d0 * area
    e = F.exp(-lam)
    safe = F.when(lam > YM.MURPHY_EPS, lam)
    g = F.when(lam > YM.MURPHY_EPS, (1.0 - e) / safe).otherwise(1.0)
    dg = F.when(lam > YM.MURPHY_EPS, (e * (lam + 1.0) - 1.0) / (safe * safe)).otherwise(-0.5)
    u = 1.0 + d0 * area / alpha
    f = F.pow(u, -alpha)
    dd0 = (F.when(model == "poisson", -area * F.exp(-lam))
           .when(model == "murphy", 2.0 * g * dg * area)
           .otherwise(-area * f / u))
    da = F.when(model == "negative_binomial", f * (-F.log(u) + (d0 * area / alpha) / u))
    return dd0, da


def covariance(curve: DataFrame, fits: DataFrame, group_cols=()) -> DataFrame:
    """MDL-08: parameter covariance (J^T W J)^-1 with absolute sigma, from
    summed Jacobian products (closed-form 1x1 / 2x2 inverse)."""
    group_cols = list(group_cols)
    ok = fits.filter(F.col("success")).select(*group_cols, "model", "d0", "alpha")
    pts = curve.select(*group_cols, "area", (point_weights() ** 2).alias("w"))
    j = pts.join(ok, group_cols, "inner") if group_cols else attach_params(pts, ok)
    dd0, da = _jacobian_cols(F.col("area"), F.col("d0"), F.col("alpha"), F.col("model"))
    s = (j.withColumn("j0", dd0).withColumn("j1", da)
         .groupBy(*group_cols, "model", "d0", "alpha")
         .agg(F.sum(F.col("w") * F.col("j0") * F.col("j0")).alias("a"),
              F.sum(F.col("w") * F.col("j0") * F.col("j1")).alias("b"),
              F.sum(F.col("w") * F.col("j1") * F.col("j1")).alias("c")))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    two = F.col("alpha").isNotNull()
    return s.select(*group_cols, "model", "d0", "alpha",
                    F.when(two, F.try_divide(F.col("c"), det)).otherwise(F.try_divide(F.lit(1.0), F.col("a")))
                    .alias("var_d0"),
                    F.when(two, F.try_divide(F.col("a"), det)).alias("var_alpha"),
                    F.when(two, F.try_divide(-F.col("b"), det)).alias("cov_d0_alpha"))

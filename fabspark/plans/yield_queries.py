"""Queries over the yield models: grid fit, scores, ranking, forward and
inverse predictions, covariance, LM fit and bundle round trip."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql_surface
from ..functions import yieldmodels as YM
from ..operators import yieldfit as YF
from ..sinks import bundle as B
from ..session import shared_dir
from ..sources import fixtures as FX
from . import yield_plan as YP
from .catalog import ORACLE, register
from .common import round_doubles, rsql
from .oracle_fixtures import with_ctes
from .wafer_queries import _blocks_sql, _COUNTS, _CURVE, _SIZES

F7 = [(m, p["D0"], p.get("alpha")) for m, p in FX.F7_PARAMS.items()]
REF_MM2 = 2.0


def _pred_sql(m="model", d="d0", a="area", al="alpha"):
    lam = f"({d} * {a})"
    core = f"((1 - exp(-{lam})) / {lam})"
    return (f"(CASE WHEN {m} = 'poisson' THEN exp(-{lam}) "
            f"WHEN {m} = 'murphy' THEN CASE WHEN {lam} > 1e-12 THEN {core} * {core} ELSE 1.0 END "
            f"ELSE pow(1 + {d} * {a} / {al}, -{al}) END)")


_F7_PARAMS_SQL = ("SELECT * FROM (VALUES ('poisson', CAST(0.0418 AS DOUBLE), CAST(NULL AS DOUBLE)), "
                  "('murphy', CAST(0.0483 AS DOUBLE), CAST(NULL AS DOUBLE)), "
                  "('negative_binomial', CAST(0.06 AS DOUBLE), CAST(1.8 AS DOUBLE))) t(model, d0, alpha)")

_CURVE_CTES = [("kept", "SELECT * FROM wafers WHERE n_die >= 100"),
               ("blocks", _blocks_sql("cells", "kept", _SIZES)), ("counts", _COUNTS),
               ("curve", _CURVE.format(min_windows=30)),
               ("pts", """SELECT area, "yield", pow(1.0 / greatest(sqrt(pc * (1 - pc) / greatest(n_valid, 1)), 1e-4), 2) AS w2
                          FROM (SELECT *, least(greatest("yield", 1e-6), 1 - 1e-6) AS pc FROM curve)""")]
_GRID = ("grid", """
  SELECT m.model, CAST(i.range AS INTEGER) AS i, CAST(NULL AS INTEGER) AS j,
         pow(10.0, CAST(-4.0 AS DOUBLE) + i.range * CAST(0.01 AS DOUBLE)) AS d0, CAST(NULL AS DOUBLE) AS alpha
  FROM (VALUES ('poisson'), ('murphy')) m(model), range(401) i
  UNION ALL
  SELECT 'negative_binomial', CAST(i.range AS INTEGER), CAST(j.range AS INTEGER),
         pow(10.0, CAST(-4.0 AS DOUBLE) + i.range * CAST(0.01 AS DOUBLE)),
         pow(10.0, CAST(-2.0 AS DOUBLE) + j.range * CAST(0.05 AS DOUBLE))
  FROM range(401) i, range(101) j""")
_FITS = [_GRID,
         ("loss", f"""SELECT g.model, g.i, g.j, g.d0, g.alpha,
                             sum(p.w2 * pow(p."yield" - {_pred_sql("g.model", "g.d0", "p.area", "g.alpha")}, 2)) AS loss
                      FROM pts p, grid g GROUP BY g.model, g.i, g.j, g.d0, g.alpha"""),
         ("fits", """SELECT model, d0, alpha, loss FROM (
                       SELECT *, row_number() OVER (PARTITION BY model ORDER BY loss, i, coalesce(j, -1)) AS rn FROM loss)
                     WHERE rn = 1""")]
_SCORES = ("scores", f"""
  SELECT model, n_params, d0, alpha, rss, sqrt(rss / n) AS rmse, sqrt(wrss / wsum) AS weighted_rmse,
         CASE WHEN ss_tot > 0 THEN 1 - rss / ss_tot END AS r2,
         n * ln(greatest(rss, 1e-12) / n) + 2 * n_params AS aic,
         n * ln(greatest(rss, 1e-12) / n) + n_params * ln(n) AS bic
  FROM (SELECT f.model, CASE WHEN f.model = 'negative_binomial' THEN 2 ELSE 1 END AS n_params, f.d0, f.alpha,
               count(*) AS n, sum(pow(p."yield" - {_pred_sql("f.model", "f.d0", "p.area", "f.alpha")}, 2)) AS rss,
               sum(p.w2 * pow(p."yield" - {_pred_sql("f.model", "f.d0", "p.area", "f.alpha")}, 2)) AS wrss,
               sum(p.w2) AS wsum, var_pop(p."yield") * count(*) AS ss_tot
        FROM pts p, fits f GROUP BY f.model, f.d0, f.alpha)""")
_BOARD = ("board", "SELECT *, row_number() OVER (ORDER BY aic, weighted_rmse, model) AS rank FROM scores")


def _grid_pipeline(spark, sf):
    curve = YP.wafer_curve(spark, sf).cache()
    fits = YF.fit_grid(curve)
    return curve, fits


# -------------------------------------------------------------------- fits
@register("mdl_06_grid_fit", rsql(with_ctes(["wafers"], "SELECT model, d0, alpha, loss FROM fits",
                                            _CURVE_CTES + _FITS), ["d0", "alpha", "loss"]))
def _mdl06(spark, sf):
    _, fits = _grid_pipeline(spark, sf)
    return round_doubles(fits.select("model", "d0", "alpha", "loss"))


_SCORE_COLS = ["d0", "alpha", "rss", "rmse", "weighted_rmse", "r2", "aic", "bic"]


@register("mdl_09_scores", rsql(with_ctes(["wafers"], "SELECT * FROM scores", _CURVE_CTES + _FITS + [_SCORES]),
                                _SCORE_COLS))
def _mdl09(spark, sf):
    curve, fits = _grid_pipeline(spark, sf)
    return round_doubles(YF.score(curve, fits))


@register("mdl_10_leaderboard", rsql(with_ctes(["wafers"], "SELECT model, rank, aic, weighted_rmse FROM board",
                                               _CURVE_CTES + _FITS + [_SCORES, _BOARD]), ["aic", "weighted_rmse"]))
def _mdl10(spark, sf):
    curve, fits = _grid_pipeline(spark, sf)
    b = YF.leaderboard(YF.score(curve, fits))
    return round_doubles(b.select("model", F.col("rank").cast("bigint").alias("rank"), "aic", "weighted_rmse"))


@register("jon_02_fits_with_scores", rsql(with_ctes(["wafers"], """
  SELECT f.model, f.d0, f.alpha, b.rank, b.aic FROM fits f LEFT JOIN board b ON b.model = f.model""",
    _CURVE_CTES + _FITS + [_SCORES, _BOARD]), ["d0", "alpha", "aic"]))
def _jon02(spark, sf):
    curve, fits = _grid_pipeline(spark, sf)
    b = YF.leaderboard(YF.score(curve, fits))
    j = YF.fits_with_scores(fits, b)
    return round_doubles(j.select("model", "d0", "alpha", F.col("rank").cast("bigint").alias("rank"), "aic"))


@register("mdl_08_covariance", rsql(with_ctes(["wafers"], f"""
  SELECT model, d0, alpha, sqrt(var_d0) AS se_d0, sqrt(var_alpha) AS se_alpha,
         cov_d0_alpha / sqrt(var_d0 * var_alpha) AS corr_d0_alpha FROM (
  SELECT model, d0, alpha,
         CASE WHEN alpha IS NULL THEN 1.0 / a ELSE c / (a * c - b * b) END AS var_d0,
         CASE WHEN alpha IS NOT NULL THEN a / (a * c - b * b) END AS var_alpha,
         CASE WHEN alpha IS NOT NULL THEN -b / (a * c - b * b) END AS cov_d0_alpha
  FROM (SELECT model, d0, alpha, sum(w2 * j0 * j0) AS a, sum(w2 * j0 * j1) AS b, sum(w2 * j1 * j1) AS c
        FROM (SELECT f.model, f.d0, f.alpha, p.w2,
                CASE WHEN f.model = 'poisson' THEN -p.area * exp(-f.d0 * p.area)
                     WHEN f.model = 'murphy' THEN CASE WHEN f.d0 * p.area > 1e-12 THEN
                          2.0 * ((1 - exp(-f.d0 * p.area)) / (f.d0 * p.area))
                          * ((exp(-f.d0 * p.area) * (f.d0 * p.area + 1.0) - 1.0) / ((f.d0 * p.area) * (f.d0 * p.area)))
                          * p.area ELSE -p.area END
                     ELSE -p.area * pow(1 + f.d0 * p.area / f.alpha, -f.alpha) / (1 + f.d0 * p.area / f.alpha) END AS j0,
                CASE WHEN f.model = 'negative_binomial' THEN pow(1 + f.d0 * p.area / f.alpha, -f.alpha)
                     * (-ln(1 + f.d0 * p.area / f.alpha) + (f.d0 * p.area / f.alpha) / (1 + f.d0 * p.area / f.alpha)) END AS j1
              FROM pts p, fits f)
        GROUP BY model, d0, alpha))""", _CURVE_CTES + _FITS), ["d0", "alpha", "se_d0", "se_alpha", "corr_d0_alpha"]))
def _mdl08(spark, sf):
    # standard errors and the correlation: well conditioned even when alpha sits at its bound
    curve, fits = _grid_pipeline(spark, sf)
    c = YF.covariance(curve, fits)
    return round_doubles(c.select("model", "d0", "alpha", F.sqrt("var_d0").alias("se_d0"),
                                  F.sqrt("var_alpha").alias("se_alpha"),
                                  (F.col("cov_d0_alpha") / F.sqrt(F.col("var_d0") * F.col("var_alpha")))
                                  .alias("corr_d0_alpha")))


# ------------------------------------------------------- forward / inverse
@register("mdl_01_03_forward_yield", rsql(with_ctes(["areas"], f"""
  SELECT a.part_id, p.model, {_pred_sql("p.model", "p.d0", "a.area", "p.alpha")} AS "yield"
  FROM areas a, params p""", [("params", _F7_PARAMS_SQL)]), ["yield"]))
def _mdl01(spark, sf):
    out = YF.forward(FX.areas(spark, sf), F7)
    return round_doubles(out.select("part_id", "model", "yield"))


@register("mdl_01_03_sql_functions", ORACLE["mdl_01_03_forward_yield"])
def _mdl01_sql(spark, sf):
    sql_surface.register(spark)
    models = ", ".join(f"struct('{r[0]}' AS model, {r[1]!r}D AS d0, {'CAST(NULL AS DOUBLE)' if r[2] is None else f'{r[2]!r}D'} AS alpha)"
                       for r in F7)
    return round_doubles(spark.sql(f"""
      SELECT a.part_id, p.model, model_yield(p.model, a.area, p.d0, p.alpha) AS yield
      FROM {{areas}} a LATERAL VIEW inline(array({models})) p AS model, d0, alpha""", areas=FX.areas(spark, sf)))


@register("mdl_11_forward_pivot", rsql(with_ctes(["areas"], f"""
  SELECT area,
         max(CASE WHEN model = 'poisson' THEN y END) AS poisson,
         max(CASE WHEN model = 'murphy' THEN y END) AS murphy,
         max(CASE WHEN model = 'negative_binomial' THEN y END) AS negative_binomial
  FROM (SELECT DISTINCT a.area, p.model, {_pred_sql("p.model", "p.d0", "a.area", "p.alpha")} AS y
        FROM areas a, params p) GROUP BY area""", [("params", _F7_PARAMS_SQL)]),
    ["area", "poisson", "murphy", "negative_binomial"]))
def _mdl11(spark, sf):
    out = YF.forward(FX.areas(spark, sf).select("area").distinct(), F7)
    return round_doubles(out.groupBy("area").pivot("model", list(YM.MODEL_ORDER)).agg(F.max("yield")))


@register("mdl_11_forward_best", rsql(with_ctes(["wafers", "areas"], f"""
  SELECT a.part_id, b.model, b.rank = 1 AS is_best, {_pred_sql("b.model", "b.d0", "a.area", "b.alpha")} AS "yield"
  FROM areas a, board b""", _CURVE_CTES + _FITS + [_SCORES, _BOARD]), ["yield"]))
def _mdl11b(spark, sf):
    curve, fits = _grid_pipeline(spark, sf)
    board = YF.leaderboard(YF.score(curve, fits))
    params = YF.collect_params(board.orderBy("rank"))
    best = params[0][0]
    out = YF.forward(FX.areas(spark, sf), params)
    return round_doubles(out.select("part_id", "model", (F.col("model") == best).alias("is_best"), "yield"))


@register("mdl_12_physical_area", rsql(with_ctes(["areas"], f"""
  SELECT a.part_id, p.model, {_pred_sql("p.model", "p.d0", f"(a.area / {REF_MM2})", "p.alpha")} AS "yield"
  FROM areas a, params p""", [("params", _F7_PARAMS_SQL)]), ["yield"]))
def _mdl12(spark, sf):
    out = YF.forward(FX.areas(spark, sf), F7, area_col="area", scale=REF_MM2)
    return round_doubles(out.select("part_id", "model", "yield"))


def _murphy_sql(x):
    lam = f"(0.0483 * {x})"
    return f"(CASE WHEN {lam} > 1e-12 THEN ((1 - exp(-{lam})) / {lam}) * ((1 - exp(-{lam})) / {lam}) ELSE 1.0 END)"


_INVERSE_SQL = f"""
  SELECT a.part_id, 'poisson' AS model,
         CASE WHEN NOT (a.target > 0 AND a.target < 1) THEN NULL
              WHEN exp(-0.0418 * 1e6) > a.target THEN CAST('inf' AS DOUBLE) ELSE -ln(a.target) / 0.0418 END AS max_area
  FROM areas a
  UNION ALL
  SELECT a.part_id, 'negative_binomial',
         CASE WHEN NOT (a.target > 0 AND a.target < 1) THEN NULL
              WHEN pow(1 + 0.06 * 1e6 / 1.8, -1.8) > a.target THEN CAST('inf' AS DOUBLE)
              ELSE 1.8 * (pow(a.target, -1.0 / 1.8) - 1.0) / 0.06 END
  FROM areas a
  UNION ALL
  SELECT part_id, 'murphy', (lo + hi) / 2 FROM bis WHERE it = 100"""
_BIS = ("bis", f"""
  SELECT part_id, target AS t, CAST(1e-9 AS DOUBLE) AS lo, CAST(1e6 AS DOUBLE) AS hi, 0 AS it FROM areas
  UNION ALL
  SELECT part_id, t,
         CASE WHEN {_murphy_sql("((lo + hi) / 2)")} > t THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN {_murphy_sql("((lo + hi) / 2)")} > t THEN hi ELSE (lo + hi) / 2 END, it + 1
  FROM bis WHERE it < 100""")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("mdl_13_inverse_area", _recursive(rsql(with_ctes(["areas"], _INVERSE_SQL, [_BIS]), ["max_area"])))
def _mdl13(spark, sf):
    out = YF.inverse(FX.areas(spark, sf), F7)
    return round_doubles(out.select("part_id", "model", "max_area"))


@register("mdl_14_inverse_mm2", _recursive(rsql(with_ctes(["areas"], f"""
  SELECT part_id, model, max_area * {REF_MM2} AS max_area_mm2 FROM ({_INVERSE_SQL})""", [_BIS]), ["max_area_mm2"])))
def _mdl14(spark, sf):
    out = YF.inverse(FX.areas(spark, sf), F7, scale=REF_MM2)
    return round_doubles(out.select("part_id", "model", F.col("max_area").alias("max_area_mm2")))


@register("mdl_15_curve_grid", rsql(with_ctes(["areas"], f"""
  SELECT g.i, p.model, g.area, {_pred_sql("p.model", "p.d0", "g.area", "p.alpha")} AS "yield"
  FROM (SELECT CAST(r.range AS INTEGER) AS i, b.lo + r.range * (b.hi - b.lo) / 199 AS area
        FROM (SELECT min(area) AS lo, max(area) AS hi FROM areas) b, range(200) r) g, params p""",
    [("params", _F7_PARAMS_SQL)]), ["area", "yield"]))
def _mdl15(spark, sf):
    b = FX.areas(spark, sf).agg(F.min("area").alias("lo"), F.max("area").alias("hi"))
    g = YF.linspace_grid(b, 200)
    out = YF.forward(g.select("i", "area"), F7)
    return round_doubles(out.select(F.col("i").cast("int").alias("i"), "model", "area", "yield"))


# The least-squares minimum of the one-parameter models, by Gauss-Newton steps with a numerical slope
# from the log-linear estimate; the fitted curve of every model is compared by its loss.
_WEIGHTS = """SELECT *, pow(1.0 / greatest(sqrt(pc * (1 - pc) / greatest(n_valid, 1)), 1e-4), 2) AS w2
  FROM (SELECT *, least(greatest("yield", 1e-6), 1 - 1e-6) AS pc FROM {curve})"""


def _steps(keys: str) -> list[tuple[str, str]]:
    model, eps = "g.model", "(1 + 1e-6)"
    at, up, down = (_pred_sql(model, d, "p.area", "1.0") for d in ("g.d0", f"g.d0 * {eps}", f"g.d0 / {eps}"))
    slope = f"(({up}) - ({down})) / (g.d0 * {eps} - g.d0 / {eps})"
    same = " AND ".join(f"p.{k} IS NOT DISTINCT FROM g.{k}" for k in keys.split(", ")) if keys else "true"
    lead = f"{keys}, " if keys else ""
    own = "".join(f"g.{k}, " for k in keys.split(", ")) if keys else ""
    return [("gn", f"""
      SELECT {lead}m.model, 0 AS it, d0 FROM (VALUES ('poisson'), ('murphy')) m(model),
             (SELECT {lead}sum(w2 * area * -ln(pc)) / sum(w2 * area * area) AS d0 FROM pts {"GROUP BY " + keys if keys else ""})
      UNION ALL
      SELECT {own}g.model, g.it + 1, g.d0 + sum(p.w2 * ({slope}) * (p."yield" - ({at}))) / sum(p.w2 * pow({slope}, 2))
      FROM gn g JOIN pts p ON {same} WHERE g.it < 40 GROUP BY {own}g.model, g.it, g.d0""")]


@register("mdl_05_one_parameter_fits", _recursive(rsql(with_ctes(["wafers"], "SELECT model, d0 FROM gn WHERE it = 40",
          _CURVE_CTES[:4] + [("pts", _WEIGHTS.format(curve="curve"))] + _steps("")), ["d0"])))
def _mdl05_one(spark, sf):
    fits = YF.fit_lm(YP.wafer_curve(spark, sf), models=["poisson", "murphy"])
    return round_doubles(fits.select("model", "d0"))


@register("mdl_07_one_parameter_fits_by_lot", _recursive(rsql(with_ctes(["wafers"], "SELECT lot_name, model, d0 FROM gn WHERE it = 40", [
    ("kept", "SELECT * FROM wafers WHERE n_die >= 100"), ("blocks", _blocks_sql("cells", "kept", _SIZES)),
    ("lots", """SELECT w.lot_name, b."window", CAST(sum(CASE WHEN has0 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
                       CAST(sum(CASE WHEN has0 = 0 AND has2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_yield
                FROM blocks b JOIN kept w USING (wafer_id) GROUP BY w.lot_name, b."window" """),
    ("lcurve", """SELECT *, CAST("window" * "window" AS DOUBLE) AS area, CAST(n_yield AS DOUBLE) / n_valid AS "yield"
                  FROM lots WHERE n_valid >= 30"""),
    ("pts", _WEIGHTS.format(curve="lcurve"))] + _steps("lot_name")), ["d0"])))
def _mdl07_one(spark, sf):
    fits = YF.fit_lm(YP.wafer_curve(spark, sf, group_cols=["lot_name"]), ["lot_name"], models=["poisson", "murphy"])
    return round_doubles(fits.select("lot_name", "model", "d0"))


def _saved_grid_bundle(spark, sf):
    """The bundle of the grid fits, written and read back."""
    bundle = YP.train_bundle(spark, sf, ref_die_area_mm2=REF_MM2, method="grid")
    return B.load_bundle(spark, B.save_bundle(bundle, shared_dir(spark, "bundle")))


@register("mdl_16_saved_bundle_answers", rsql(with_ctes(["wafers", "areas"], f"""
  SELECT a.part_id, f.model, {_pred_sql("f.model", "f.d0", f"a.area / {REF_MM2}", "f.alpha")} AS "yield"
  FROM areas a, fits f""", _CURVE_CTES + _FITS), ["yield"]))
def _mdl16_answers(spark, sf):
    loaded = B.bundle_params(_saved_grid_bundle(spark, sf))
    return round_doubles(YF.forward(FX.areas(spark, sf), loaded, scale=REF_MM2).select("part_id", "model", "yield"))


@register("snk_04_saved_bundle_rows", rsql(with_ctes(["wafers"], f"""
  SELECT 1 AS schema_version, CAST({REF_MM2} AS DOUBLE) AS ref_die_area_mm2, b.model, b.model = t.model AS is_best, true AS success,
         b.d0, b.alpha, b.rmse, b.weighted_rmse, b.r2, b.aic, b.bic, 'grid' AS method
  FROM board b, (SELECT model FROM board WHERE rank = 1) t""", _CURVE_CTES + _FITS + [_SCORES, _BOARD]),
    ["ref_die_area_mm2", "d0", "alpha", "rmse", "weighted_rmse", "r2", "aic", "bic"]))
def _snk04_rows(spark, sf):
    rows = _saved_grid_bundle(spark, sf).select(
        "schema_version", "ref_die_area_mm2", "best_model", F.col("metadata")["method"].alias("method"),
        F.explode("models").alias("model", "m"))
    return round_doubles(rows.select(
        "schema_version", "ref_die_area_mm2", "model", (F.col("model") == F.col("best_model")).alias("is_best"), "m.success",
        F.col("m.params")["D0"].alias("d0"), F.col("m.params")["alpha"].alias("alpha"),
        *[F.col("m.scores")[c].alias(c) for c in ("rmse", "weighted_rmse", "r2", "aic", "bic")], "method"))


# ------------------------------------------------------------ rows-only
@register("mdl_05_lm_fit")
def _mdl05(spark, sf):
    curve = YP.wafer_curve(spark, sf).cache()
    fits = YF.fit_lm(curve)
    return fits.select("model", F.round("d0", 4).alias("d0"), F.round("alpha", 3).alias("alpha"),
                       "success", "message")


@register("mdl_07_fit_all_by_lot")
def _mdl07(spark, sf):
    curve = YP.wafer_curve(spark, sf, group_cols=["lot_name"]).cache()
    fits = YF.fit_lm(curve, ["lot_name"])
    return fits.select("lot_name", "model", "d0", "alpha", "success")


@register("mdl_16_bundle_roundtrip")
def _mdl16(spark, sf):
    bundle = YP.train_bundle(spark, sf, ref_die_area_mm2=REF_MM2)
    path = B.save_bundle(bundle, shared_dir(spark, "bundle"))
    loaded = B.bundle_params(B.load_bundle(spark, path))
    return round_doubles(YF.forward(FX.areas(spark, sf), loaded, scale=REF_MM2)
                         .select("part_id", "model", "yield"))

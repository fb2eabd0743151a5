"""Queries over wafer maps: windows, curve, projections, filters, labels."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql_surface
from ..operators import wafer as W
from ..sources import fixtures as FX
from ..functions.labels import YIELD_UNLABELED
from .catalog import register
from .common import round_doubles, rsql
from .oracle_fixtures import h, with_ctes


def labelled_wafers(spark, sf_dir: str) -> DataFrame:
    """F1 wafers with F6 labels attached (left join on wafer id)."""
    lab = FX.raw_labels(spark, sf_dir)
    return W.with_labels(FX.wafers(spark, sf_dir).join(lab, "wafer_id", "left"))


# ------------------------------------------------------------- oracle pieces
def _blocks_sql(cells: str, dims: str, sizes: list[int]) -> str:
    arr = ", ".join(str(s) for s in sizes)
    return f"""
  SELECT c.wafer_id, ws.w AS "window", c.r // ws.w AS bi, c.c // ws.w AS bj,
         max(CASE WHEN c.cell = 0 THEN 1 ELSE 0 END) AS has0,
         max(CASE WHEN c.cell = 2 THEN 1 ELSE 0 END) AS has2
  FROM {cells} c JOIN {dims} d ON d.wafer_id = c.wafer_id
  CROSS JOIN (SELECT CAST(unnest([{arr}]) AS INTEGER) AS w) ws
  WHERE (c.r // ws.w + 1) * ws.w <= d.rows AND (c.c // ws.w + 1) * ws.w <= d.cols
  GROUP BY c.wafer_id, ws.w, c.r // ws.w, c.c // ws.w"""


_COUNTS = """
  SELECT "window", CAST(sum(CASE WHEN has0 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
         CAST(sum(CASE WHEN has0 = 0 AND has2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_yield
  FROM blocks GROUP BY "window" """

_CURVE = """
  SELECT "window", CAST("window" * "window" AS DOUBLE) AS area,
         CAST(n_yield AS DOUBLE) / n_valid AS "yield", n_valid, n_yield
  FROM counts WHERE n_valid >= {min_windows}"""

_SIZES = list(W.WINDOW_SIZES)


def _curve_sql(min_windows: int = W.MIN_WINDOWS_PER_AREA) -> str:
    return rsql(with_ctes(["wafers"], _CURVE.format(min_windows=min_windows),
                          [("kept", "SELECT * FROM wafers WHERE n_die >= 100"),
                           ("blocks", _blocks_sql("cells", "kept", _SIZES)),
                           ("counts", _COUNTS)]), ["yield"])


# ---------------------------------------------------------------- WAF-01..06
def _flagship_curve(spark, sf_dir, method="kernel", min_windows=W.MIN_WINDOWS_PER_AREA):
    wf = W.filter_wafers(FX.wafers(spark, sf_dir), W.MIN_DIE_COUNT)
    return W.yield_curve(wf, min_windows=min_windows, method=method)


@register("waf_03_sql_table_function", _curve_sql())
def _waf03_sql(spark, sf):
    sql_surface.register(spark)
    return round_doubles(spark.sql(f"""
      SELECT d.die_window AS `window`, CAST(d.die_window * d.die_window AS DOUBLE) AS area,
             sum(d.n_yield) / sum(d.n_valid) AS yield, sum(d.n_valid) AS n_valid, sum(d.n_yield) AS n_yield
      FROM {{wafers}} m, LATERAL die_windows(m.cells, m.rows, m.cols, array({", ".join(map(str, W.WINDOW_SIZES))})) d
      GROUP BY d.die_window HAVING sum(d.n_valid) >= {W.MIN_WINDOWS_PER_AREA}""",
        wafers=W.filter_wafers(FX.wafers(spark, sf), W.MIN_DIE_COUNT)))


register("waf_03_yield_curve", _curve_sql())(
    lambda spark, sf: round_doubles(_flagship_curve(spark, sf)))

register("waf_01_cells_form_curve", _curve_sql())(
    lambda spark, sf: round_doubles(_flagship_curve(spark, sf, method="cells")))

register("flt_06_min_windows_1000", _curve_sql(1000))(
    lambda spark, sf: round_doubles(_flagship_curve(spark, sf, min_windows=1000)))


@register("waf_01_window_counts_by_wafer", with_ctes(["wafers"], """
  SELECT wafer_id, "window", CAST(sum(CASE WHEN has0 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
         CAST(sum(CASE WHEN has0 = 0 AND has2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_yield
  FROM blocks GROUP BY wafer_id, "window" """, [("blocks", _blocks_sql("cells", "wafers", _SIZES))]))
def _waf01(spark, sf):
    return W.count_windows(FX.wafers(spark, sf), group_cols=["wafer_id"])


@register("waf_01_ragged_window_counts", with_ctes(["rwafers"], """
  SELECT s.w AS "window", CAST(coalesce(c.n_valid, 0) AS BIGINT) AS n_valid,
         CAST(coalesce(c.n_yield, 0) AS BIGINT) AS n_yield
  FROM (SELECT CAST(unnest([1,2,3,4,5,6,7,8,21,22,23]) AS INTEGER) AS w) s
  LEFT JOIN counts c ON c."window" = s.w""",
    [("blocks", _blocks_sql("rcells", "rwafers", _SIZES + [21, 22, 23])), ("counts", _COUNTS)]))
def _waf01r(spark, sf):
    return W.count_windows(FX.ragged_wafers(spark, sf), sizes=tuple(_SIZES + [21, 22, 23]))


@register("waf_02_strided_curve", rsql(with_ctes(["wafers"], _CURVE.format(min_windows=30), [
    ("origins", """
      SELECT d.wafer_id, ws.w, oi.range AS i, oj.range AS j
      FROM wafers d CROSS JOIN (SELECT CAST(unnest([1,2,3,4,5,6,7,8]) AS INTEGER) AS w) ws
      CROSS JOIN range(24) oi CROSS JOIN range(24) oj
      WHERE oi.range + ws.w <= d.rows AND oj.range + ws.w <= d.cols"""),
    ("blocks", """
      SELECT o.wafer_id, o.w AS "window", o.i, o.j,
             max(CASE WHEN c.cell = 0 THEN 1 ELSE 0 END) AS has0,
             max(CASE WHEN c.cell = 2 THEN 1 ELSE 0 END) AS has2
      FROM origins o JOIN cells c ON c.wafer_id = o.wafer_id
       AND c.r >= o.i AND c.r < o.i + o.w AND c.c >= o.j AND c.c < o.j + o.w
      GROUP BY o.wafer_id, o.w, o.i, o.j"""),
    ("counts", _COUNTS)]), ["yield"]))
def _waf02(spark, sf):
    return round_doubles(W.yield_curve(FX.wafers(spark, sf), stride=1))


@register("waf_04_point_weights", rsql(with_ctes(["wafers"], """
  SELECT "window", "yield", n_valid,
         1.0 / greatest(sqrt(least(greatest("yield", 1e-6), 1 - 1e-6)
                         * (1 - least(greatest("yield", 1e-6), 1 - 1e-6)) / greatest(n_valid, 1)), 1e-4) AS weight
  FROM curve""", [("kept", "SELECT * FROM wafers WHERE n_die >= 100"),
                  ("blocks", _blocks_sql("cells", "kept", _SIZES)), ("counts", _COUNTS),
                  ("curve", _CURVE.format(min_windows=30))]), ["yield", "weight"]))
def _waf04(spark, sf):
    c = _flagship_curve(spark, sf)
    return round_doubles(c.select("window", "yield", "n_valid", W.point_weights().alias("weight")))


@register("waf_06_curve_by_lot", rsql(with_ctes(["wafers"], """
  SELECT lot_name, "window", CAST("window" * "window" AS DOUBLE) AS area,
         CAST(n_yield AS DOUBLE) / n_valid AS "yield", n_valid, n_yield
  FROM (SELECT w.lot_name, b."window",
               CAST(sum(CASE WHEN has0 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
               CAST(sum(CASE WHEN has0 = 0 AND has2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_yield
        FROM blocks b JOIN wafers w USING (wafer_id) GROUP BY w.lot_name, b."window")
  WHERE n_valid >= 30""", [("blocks", _blocks_sql("cells", "wafers", _SIZES))]), ["yield"]))
def _waf06(spark, sf):
    return round_doubles(W.yield_curve(FX.wafers(spark, sf), group_cols=["lot_name"]))


# ------------------------------------------------------------------- PRJ-*
@register("prj_04_wafer_summary", rsql(with_ctes(["rwafers"], """
  SELECT wafer_id, n_die, n_bad, CASE WHEN n_die = 0 THEN NULL ELSE CAST(n_bad AS DOUBLE) / n_die END AS defect_rate
  FROM rwafers"""), ["defect_rate"]))
def _prj04(spark, sf):
    return round_doubles(W.with_summary(FX.ragged_wafers(spark, sf)).select("wafer_id", "n_die", "n_bad", "defect_rate"))


@register("prj_05_dims", with_ctes(["rwafers"], """
  SELECT "rows", cols, count(*) AS n_wafers FROM rwafers GROUP BY "rows", cols"""))
def _prj05(spark, sf):
    return W.dims(FX.ragged_wafers(spark, sf)).groupBy("rows", "cols").agg(F.count("*").alias("n_wafers"))


@register("prj_06_resize_normalize", rsql(with_ctes(["rwafers"], """
  SELECT d.wafer_id, sum(CAST(c.cell AS DOUBLE) / 2.0 * (k.range + 1)) AS checksum,
         count(*) FILTER (WHERE c.cell = 2) AS n_bad_resized, count(*) FILTER (WHERE c.cell <> 0) AS n_die_resized
  FROM rwafers d CROSS JOIN range(256) k
  JOIN rcells c ON c.wafer_id = d.wafer_id
   AND c.r = least(floor((k.range // 16) * d.rows / 16), d.rows - 1)
   AND c.c = least(floor((k.range % 16) * d.cols / 16), d.cols - 1)
  GROUP BY d.wafer_id"""), ["checksum"]))
def _prj06(spark, sf):
    r = W.resized(FX.ragged_wafers(spark, sf), 16)
    return round_doubles(r.select(
        "wafer_id",
        F.aggregate(F.transform("x", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0),
                    lambda a, b: a + b).alias("checksum"),
        F.size(F.filter("x", lambda v: v == 1.0)).cast("long").alias("n_bad_resized"),
        F.size(F.filter("x", lambda v: v != 0.0)).cast("long").alias("n_die_resized")))


@register("prj_09_dihedral_variants", with_ctes(["cells"], """
  SELECT o.wafer_id, o.variant, CAST(sum(CAST(c.cell AS BIGINT) * (o.i * 24 + o.j + 1)) AS BIGINT) AS checksum
  FROM (SELECT s.wafer_id, v.range AS variant, p.i, p.j,
               CASE WHEN v.range >= 4 THEN 23 - p.j ELSE p.j END AS j2
        FROM (SELECT DISTINCT wafer_id FROM cells) s CROSS JOIN range(8) v
        CROSS JOIN (SELECT a.range AS i, b.range AS j FROM range(24) a, range(24) b) p) o
  JOIN cells c ON c.wafer_id = o.wafer_id
   AND c.r = CASE o.variant % 4 WHEN 0 THEN o.i WHEN 1 THEN o.j2 WHEN 2 THEN 23 - o.i ELSE 23 - o.j2 END
   AND c.c = CASE o.variant % 4 WHEN 0 THEN o.j2 WHEN 1 THEN 23 - o.i WHEN 2 THEN 23 - o.j2 ELSE o.i END
  GROUP BY o.wafer_id, o.variant"""))
def _prj09(spark, sf):
    a = W.augment(FX.wafers(spark, sf), 24, all_variants=True)
    return a.select("wafer_id", F.col("variant").cast("bigint").alias("variant"),
                    F.aggregate(F.transform("cells", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"),
                                lambda x, y: x + y).alias("checksum"))


# ------------------------------------------------------------------ labels
_LABELLED = """
  SELECT w.wafer_id, w.n_die, coalesce(l.label, 'Unlabeled') AS label
  FROM wafers w LEFT JOIN labels6 l ON l.wafer_id = w.wafer_id"""


@register("prj_02_label_cnn", with_ctes(["labels6"], "SELECT wafer_id, label FROM labels6"))
def _prj02(spark, sf):
    return W.with_labels(FX.raw_labels(spark, sf)).select("wafer_id", "label")


@register("prj_01_label_yield", with_ctes(["labels6"], """
  SELECT wafer_id, CASE WHEN label = 'Unlabeled' THEN 'unlabeled' ELSE label END AS label FROM labels6"""))
def _prj01(spark, sf):
    return W.with_labels(FX.raw_labels(spark, sf), token=YIELD_UNLABELED).select("wafer_id", "label")


@register("flt_01_wafer_filter", with_ctes(["wafers", "labels6"], f"""
  SELECT wafer_id, label, n_die FROM ({_LABELLED})
  WHERE n_die >= 100 AND label IN ('Center', 'Scratch', 'none', 'Unlabeled')"""))
def _flt01(spark, sf):
    wf = W.filter_wafers(labelled_wafers(spark, sf), 100, ["Center", "Scratch", "none", "Unlabeled"])
    return W.with_summary(wf).select("wafer_id", "label", "n_die")


@register("flt_02_seeded_cap", with_ctes(["wafers"], f"""
  SELECT wafer_id, lot_name FROM wafers
  ORDER BY {h("CAST(wafer_id AS VARCHAR) || ':42'")}, wafer_id LIMIT 37"""))
def _flt02(spark, sf):
    return W.cap_wafers(FX.wafers(spark, sf), 37, seed=42).select("wafer_id", "lot_name")


@register("flt_03_filter_labeled", with_ctes(["labels6"], """
  SELECT wafer_id, label FROM labels6 WHERE label <> 'Unlabeled' AND lower(label) <> 'none'"""))
def _flt03(spark, sf):
    return W.filter_labeled(W.with_labels(FX.raw_labels(spark, sf))).select("wafer_id", "label")

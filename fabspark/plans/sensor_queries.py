"""Queries over splits (SPL), leak-free preparation (FIT) and resampling (RES)
on the sensor fixtures F2 / dense F2 and the label fixture F6."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as PR
from ..operators import resample as RS
from ..operators import smote as SM
from ..operators import split as SP
from ..operators import wafer as W
from ..sources import fixtures as FX
from .catalog import register
from .common import round_doubles, rsql
from .oracle_fixtures import h60, neighbour_mi_sql, with_ctes


# ------------------------------------------------------------ SQL helpers
def _alloc(counts: str, cls: str, frac: str, out: str) -> list[tuple[str, str]]:
    """CTEs giving ``out(cls, n_c, n_test)`` like ``split.test_sizes``."""
    return [
        (f"{out}_t", f"SELECT sum(n_c) AS n, CAST(ceil({frac} * sum(n_c)) AS BIGINT) AS n_test FROM {counts}"),
        (f"{out}_a", f"""SELECT c.{cls}, c.n_c, CAST(c.n_c AS DOUBLE) / t.n * (t.n - t.n_test) AS cont
                         FROM {counts} c, {out}_t t"""),
        (f"{out}_r", f"""SELECT *, floor(cont) AS fl, cont - floor(cont) AS fr,
                                row_number() OVER (ORDER BY cont - floor(cont) DESC, {cls}) AS rr,
                                (SELECT n - n_test FROM {out}_t) - sum(floor(cont)) OVER () AS need
                         FROM {out}_a"""),
        (out, f"""SELECT {cls}, n_c, CAST(n_c - (fl + CASE WHEN rr <= need AND fr > 0 THEN 1 ELSE 0 END) AS BIGINT)
                  AS n_test FROM {out}_r"""),
    ]


def _rank(id_col: str, cls: str | None) -> str:
    part = f"PARTITION BY {cls} " if cls else ""
    return f"row_number() OVER ({part}ORDER BY {h60(f'CAST({id_col} AS VARCHAR) || {chr(39)}:42{chr(39)}')}, {id_col})"


_SPLIT1 = ([("cc", "SELECT y, count(*) AS n_c FROM units GROUP BY y")]
           + _alloc("cc", "y", "CAST(0.2 AS DOUBLE)", "sa")
           + [("ranked", f"SELECT unit_id, y, {_rank('unit_id', 'y')} AS rk FROM units"),
              ("split1", """SELECT r.unit_id, r.y, CASE WHEN r.rk <= a.n_test THEN 'test' ELSE 'train' END AS split
                            FROM ranked r JOIN sa a USING (y)""")])


@register("spl_01_stratified_split", with_ctes(["units"], "SELECT unit_id, y, split FROM split1", _SPLIT1))
def _spl01(spark, sf):
    return SP.stratified_split(FX.sensors(spark, sf).select("unit_id", "y")).select("unit_id", "y", "split")


_LAB = ("lab", "SELECT wafer_id, label FROM labels6 WHERE label <> 'Unlabeled'")
_SPLIT3 = ([_LAB, ("c3", "SELECT label, count(*) AS n_c FROM lab GROUP BY label")]
           + _alloc("c3", "label", "CAST(0.15 AS DOUBLE)", "t3")
           + [("c3r", "SELECT label, n_c - n_test AS n_c FROM t3")]
           + _alloc("c3r", "label", "CAST(0.15 AS DOUBLE) / CAST(0.85 AS DOUBLE)", "v3")
           + [("r3", f"SELECT wafer_id, label, {_rank('wafer_id', 'label')} AS rk FROM lab"),
              ("split3", """SELECT r.wafer_id, r.label,
                                   CASE WHEN r.rk <= t.n_test THEN 'test' WHEN r.rk <= t.n_test + v.n_test THEN 'val'
                                        ELSE 'train' END AS split
                            FROM r3 r JOIN t3 t USING (label) JOIN v3 v USING (label)""")])


def _three_way(spark, sf):
    lab = W.filter_labeled(W.with_labels(FX.raw_labels(spark, sf)), drop_none=False)
    return SP.stratified_three_way(lab.select("wafer_id", "label"))


@register("spl_02_three_way_split", with_ctes(["labels6"], "SELECT wafer_id, label, split FROM split3", _SPLIT3))
def _spl02(spark, sf):
    return _three_way(spark, sf).select("wafer_id", "label", "split")


@register("agg_12_split_class_counts", with_ctes(["labels6"], """
  SELECT split, label, count(*) AS count FROM split3 GROUP BY ROLLUP (split, label)""", _SPLIT3))
def _agg12(spark, sf):
    return _three_way(spark, sf).rollup("split", "label").agg(F.count("*").alias("count"))


@register("spl_03_stratified_folds", with_ctes(["units"], """
  SELECT unit_id, y, CAST((rk - 1 + st) % 5 AS INTEGER) AS fold
  FROM (SELECT u.unit_id, u.y, u.rk, coalesce(sum(c.n_c) FILTER (WHERE c.y < u.y), 0) AS st
        FROM ranked u, cc c GROUP BY u.unit_id, u.y, u.rk)""", _SPLIT1))
def _spl03(spark, sf):
    return SP.stratified_folds(FX.sensors(spark, sf).select("unit_id", "y"), 5).select("unit_id", "y", "fold")


# -------------------------------------------------------------- FIT chain
_FIT = _SPLIT1 + [
    ("tr", "SELECT s.* FROM slong s JOIN split1 p USING (unit_id) WHERE p.split = 'train'"),
    ("rates", "SELECT i, CAST(count(*) FILTER (WHERE v IS NULL) AS DOUBLE) / count(*) AS rate FROM tr GROUP BY i"),
    ("ind", "SELECT i, CAST(64 + row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS j FROM rates WHERE rate > 0.05 AND rate < 1"),
    ("names1", """SELECT i AS j, printf('feature_%03d', i) AS feature FROM rates
                  UNION ALL SELECT j, printf('feature_%03d__missing', i) FROM ind"""),
    ("x1", """SELECT unit_id, i AS j, v FROM slong
              UNION ALL SELECT s.unit_id, d.j, CASE WHEN s.v IS NULL THEN 1.0 ELSE 0.0 END FROM slong s JOIN ind d USING (i)"""),
    ("r1", "SELECT i AS j, rate FROM rates UNION ALL SELECT j, 0.0 FROM ind"),
    ("keep1", "SELECT j, CAST(row_number() OVER (ORDER BY j) - 1 AS INTEGER) AS p FROM r1 WHERE rate <= 0.5"),
    ("med", """SELECT k.p, quantile_cont(x.v, 0.5) AS m FROM x1 x JOIN keep1 k USING (j)
               JOIN split1 s USING (unit_id) WHERE s.split = 'train' AND x.v IS NOT NULL GROUP BY k.p"""),
    ("x2", "SELECT x.unit_id, k.j, k.p, coalesce(x.v, m.m) AS v FROM x1 x JOIN keep1 k USING (j) JOIN med m USING (p)"),
    ("st", """SELECT x.p, any_value(x.j) AS j, var_pop(x.v) AS var, avg(x.v) AS mean, stddev_pop(x.v) AS sd
              FROM x2 x JOIN split1 s USING (unit_id) WHERE s.split = 'train' GROUP BY x.p"""),
    ("keep2", """SELECT p, j, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS q, mean,
                        CASE WHEN sd = 0 OR sd IS NULL THEN 1.0 ELSE sd END AS sd FROM st WHERE var > 1e-8"""),
    ("x3", "SELECT x.unit_id, k.q, (x.v - k.mean) / k.sd AS v FROM x2 x JOIN keep2 k USING (p)"),
]


def _prep(spark, sf, k=None):
    s = SP.stratified_split(FX.sensors(spark, sf)).cache()
    train = s.filter(F.col("split") == "train")
    return s, PR.fit(train, k_features=k)


def _names_df(spark, names, col="feature"):
    # a list with one entry per feature of the fitted model (bounded by the width)
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"pos int, {col} string")


@register("fit_01_missing_indicators", with_ctes(["units", "slong"], """
  SELECT CAST(row_number() OVER (ORDER BY j) - 1 AS INTEGER) AS pos, feature
  FROM names1 WHERE j >= 64""", _FIT))
def _fit01(spark, sf):
    _, m = _prep(spark, sf)
    return _names_df(spark, [f"{m.names_in[i]}__missing" for i in m.indicator_idx])


@register("fit_02_missing_threshold", with_ctes(["units", "slong"], """
  SELECT k.p AS pos, n.feature FROM keep1 k JOIN names1 n USING (j)""", _FIT))
def _fit02(spark, sf):
    _, m = _prep(spark, sf)
    n1 = m.names_with_indicators
    return _names_df(spark, [n1[j] for j in m.keep_missing])


@register("fit_04_variance_threshold", with_ctes(["units", "slong"], """
  SELECT k.q AS pos, n.feature FROM keep2 k JOIN names1 n USING (j)""", _FIT))
def _fit04(spark, sf):
    _, m = _prep(spark, sf)
    return _names_df(spark, m.feature_names)


@register("fit_05_scaler_params", rsql(with_ctes(["units", "slong"], """
  SELECT k.q AS pos, n.feature, k.mean, k.sd AS std FROM keep2 k JOIN names1 n USING (j)""", _FIT), ["mean", "std"]))
def _fit05(spark, sf):
    _, m = _prep(spark, sf)
    rows = [(i, n, mu, sd) for i, (n, mu, sd) in enumerate(zip(m.feature_names, m.means, m.stds))]
    return round_doubles(spark.createDataFrame(rows, "pos int, feature string, mean double, std double"))


@register("fit_08_transform_test", rsql(with_ctes(["units", "slong"], """
  SELECT x.unit_id, count(*) AS n_features, sum(x.v * (x.q + 1)) AS checksum
  FROM x3 x JOIN split1 s USING (unit_id) WHERE s.split = 'test' GROUP BY x.unit_id""", _FIT), ["checksum"]))
def _fit08(spark, sf):
    s, m = _prep(spark, sf)
    t = m.transform(s.filter(F.col("split") == "test"))
    return round_doubles(t.select(
        "unit_id", F.size("features").cast("long").alias("n_features"),
        F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        .alias("checksum")))


_ANOVA = ("anova", """
  SELECT q, (ssb / (k - 1)) / nullif(ssw / (n - k), 0) AS score FROM (
    SELECT q, sum(nc) AS n, count(*) AS k, sum(sc * sc / nc) - sum(sc) * sum(sc) / sum(nc) AS ssb,
           sum(ssc) - sum(sc * sc / nc) AS ssw
    FROM (SELECT x.q, s.y, count(*) AS nc, sum(x.v) AS sc, sum(x.v * x.v) AS ssc
          FROM x3 x JOIN split1 s USING (unit_id) WHERE s.split = 'train' GROUP BY x.q, s.y)
    GROUP BY q)""")


@register("fit_06_anova_scores", rsql(with_ctes(["units", "slong"], """
  SELECT a.q AS pos, n.feature, a.score FROM anova a JOIN keep2 k USING (q) JOIN names1 n USING (j)""",
    _FIT + [_ANOVA]), ["score"]))
def _fit06(spark, sf):
    s, m = _prep(spark, sf)
    train = m.transform(s.filter(F.col("split") == "train"))
    sc = PR.anova_f(train, "features", "y")
    names = _names_df(spark, m.feature_names).withColumnRenamed("pos", "i")
    return round_doubles(sc.join(names, "i").select(F.col("i").cast("int").alias("pos"), "feature", "score"))


@register("fit_07_selected_features", with_ctes(["units", "slong"], """
  SELECT CAST(row_number() OVER (ORDER BY a.q) - 1 AS INTEGER) AS pos, n.feature
  FROM (SELECT q FROM anova ORDER BY score DESC NULLS LAST, q DESC LIMIT 10) a
  JOIN keep2 k USING (q) JOIN names1 n USING (j)""", _FIT + [_ANOVA]))
def _fit07(spark, sf):
    _, m = _prep(spark, sf, k=10)
    return _names_df(spark, m.feature_names)


_MI = [("kept", """SELECT x.unit_id, k.q AS i, s.y, x.v FROM x2 x JOIN keep2 k USING (p) JOIN split1 s USING (unit_id)
                   WHERE s.split = 'train'""")] + neighbour_mi_sql("kept", "unit_id")


@register("fit_06_mutual_info_scores", rsql(with_ctes(["units", "slong"], """
  SELECT a.i AS pos, n.feature, a.mutual_info AS score FROM mi a JOIN keep2 k ON k.q = a.i JOIN names1 n USING (j)""",
    _FIT + _MI), ["score"]))
def _fit06_mi(spark, sf):
    s, m = _prep(spark, sf)
    names = _names_df(spark, m.feature_names).withColumnRenamed("pos", "i")
    sc = PR.mutual_info_scores(m, s.filter(F.col("split") == "train"))
    return round_doubles(sc.join(names, "i").select(F.col("i").cast("int").alias("pos"), "feature", "score"))


@register("fit_07_selected_by_mutual_info", with_ctes(["units", "slong"], """
  SELECT CAST(row_number() OVER (ORDER BY a.i) - 1 AS INTEGER) AS pos, n.feature
  FROM (SELECT i FROM mi ORDER BY round(mutual_info, 12) DESC, i DESC LIMIT 10) a
  JOIN keep2 k ON k.q = a.i JOIN names1 n USING (j)""", _FIT + _MI))
def _fit07_mi(spark, sf):
    s = SP.stratified_split(FX.sensors(spark, sf))
    m = PR.fit(s.filter(F.col("split") == "train"), k_features=10, score="mutual_info")
    return _names_df(spark, m.feature_names)


# ------------------------------------------------------------- resampling
def _units(spark, sf):
    return FX.sensors(spark, sf).select("unit_id", "y")


_MINRANK = ("mr", f"SELECT unit_id, {_rank('unit_id', None)} AS rk FROM units WHERE y = 1")


@register("res_03_random_over", with_ctes(["units"], f"""
  SELECT unit_id, y, false AS synthetic FROM units
  UNION ALL
  SELECT m.unit_id, 1 AS y, true AS synthetic
  FROM (SELECT {h60("CAST(range AS VARCHAR) || ':draw:42'")} % (SELECT count(*) FROM units WHERE y = 1) + 1 AS rk
        FROM range((SELECT count(*) FROM units WHERE y = 0) - (SELECT count(*) FROM units WHERE y = 1))) d
  JOIN mr m USING (rk)""", [_MINRANK]))
def _res03(spark, sf):
    return RS.random_over(_units(spark, sf)).select("unit_id", "y", "synthetic")


@register("res_04_random_under", with_ctes(["units"], f"""
  SELECT unit_id, y FROM (SELECT unit_id, y, {_rank('unit_id', 'y')} AS rk FROM units)
  WHERE rk <= (SELECT count(*) FROM units WHERE y = 1)"""))
def _res04(spark, sf):
    return RS.random_under(_units(spark, sf)).select("unit_id", "y")


@register("res_02_class_weight", rsql(with_ctes(["units"], """
  SELECT unit_id, y, (SELECT count(*) FROM units) * 1.0 / (2 * count(*) OVER (PARTITION BY y)) AS weight FROM units"""),
    ["weight"]))
def _res02(spark, sf):
    return round_doubles(RS.apply(_units(spark, sf), "class_weight").select("unit_id", "y", "weight"))


@register("res_01_none", with_ctes(["units"], "SELECT unit_id, y FROM units"))
def _res01(spark, sf):
    return RS.apply(_units(spark, sf), "none").select("unit_id", "y")


@register("res_10_strategy_comparison", with_ctes(["units"], f"""
  SELECT 'none' AS strategy, '{RS.DESCRIPTIONS['none']}' AS description, y, count(*) AS count FROM units GROUP BY y
  UNION ALL SELECT 'class_weight', '{RS.DESCRIPTIONS['class_weight']}', y, count(*) FROM units GROUP BY y
  UNION ALL SELECT 'random_over', '{RS.DESCRIPTIONS['random_over']}', y,
                   CASE WHEN y = 1 THEN (SELECT count(*) FROM units WHERE y = 0) ELSE count(*) END FROM units GROUP BY y
  UNION ALL SELECT 'random_under', '{RS.DESCRIPTIONS['random_under']}', y,
                   (SELECT count(*) FROM units WHERE y = 1) FROM units GROUP BY y"""))
def _res10(spark, sf):
    return RS.strategy_comparison(_units(spark, sf))


# SMOTE on the dense fixture: minority k-NN, hash-seeded draws, interpolation
_KNN_MIN = ("nn", """
  SELECT qid, CAST(slot AS INTEGER) AS slot, nid FROM (
    SELECT a.unit_id AS qid, b.unit_id AS nid,
           row_number() OVER (PARTITION BY a.unit_id ORDER BY list_sum(list_transform(list_zip(a.x, b.x),
                              lambda t: (t[1] - t[2]) * (t[1] - t[2]))), b.unit_id) - 1 AS slot
    FROM dense a JOIN dense b ON a.y = 1 AND b.y = 1 AND a.unit_id <> b.unit_id) WHERE slot < 5""")
_SMOTE = [_KNN_MIN,
          ("sr", f"SELECT unit_id, x, {_rank('unit_id', None)} AS srank FROM dense WHERE y = 1"),
          ("draws", f"""
            SELECT range AS draw,
                   {h60("CAST(range AS VARCHAR) || ':s:42'")} % (SELECT count(*) FROM dense WHERE y = 1) + 1 AS srank,
                   CAST({h60("CAST(range AS VARCHAR) || ':n:42'")} % 5 AS INTEGER) AS slot,
                   CAST({h60("CAST(range AS VARCHAR) || ':u:42'")} % 1048576 AS DOUBLE) / 1048576 AS u
            FROM range((SELECT count(*) FROM dense WHERE y = 0) - (SELECT count(*) FROM dense WHERE y = 1))"""),
          ("syn", """
            SELECT -(d.draw + 1) AS unit_id, 1 AS y,
                   list_transform(list_zip(s.x, m.x), lambda t: t[1] + d.u * (t[2] - t[1])) AS x
            FROM draws d JOIN sr s USING (srank) JOIN nn ON nn.qid = s.unit_id AND nn.slot = d.slot
            JOIN dense m ON m.unit_id = nn.nid""")]


def _checksum_sql(src: str) -> str:
    return f"""SELECT unit_id, y, unit_id < 0 AS synthetic,
                      list_sum(list_transform(list_zip(x, range(1, 65)), lambda t: t[1] * t[2])) AS checksum
               FROM {src}"""


def _checksum(df):
    return round_doubles(df.select(
        "unit_id", "y", (F.col("unit_id") < 0).alias("synthetic"),
        F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b).alias("checksum")))


@register("res_05_smote", rsql(with_ctes(["dense"], _checksum_sql(
    "(SELECT unit_id, y, x FROM dense UNION ALL SELECT unit_id, y, x FROM syn)"), _SMOTE), ["checksum"]))
def _res05(spark, sf):
    return _checksum(SM.smote(FX.dense_sensors(spark, sf)))


_KNN_ALL = """
  SELECT qid, nid, nlabel, qlabel, CAST(slot AS INTEGER) AS slot FROM (
    SELECT a.unit_id AS qid, b.unit_id AS nid, b.y AS nlabel, a.y AS qlabel,
           row_number() OVER (PARTITION BY a.unit_id ORDER BY list_sum(list_transform(list_zip(a.x, b.x),
                              lambda t: (t[1] - t[2]) * (t[1] - t[2]))), b.unit_id) - 1 AS slot
    FROM {src} a JOIN {src} b ON a.unit_id <> b.unit_id) WHERE slot < {k}"""


SMOTE_ENN = _SMOTE + [("sm", "SELECT unit_id, y, x FROM dense UNION ALL SELECT unit_id, y, x FROM syn"),
                     ("nn3", _KNN_ALL.format(src="sm", k=3))]


@register("res_08_smote_enn", rsql(with_ctes(["dense"], _checksum_sql(
    "(SELECT * FROM sm WHERE unit_id NOT IN (SELECT qid FROM nn3 WHERE nlabel <> qlabel))"),
    SMOTE_ENN), ["checksum"]))
def _res08(spark, sf):
    return _checksum(SM.smote_enn(FX.dense_sensors(spark, sf)))


@register("res_09_smote_tomek", rsql(with_ctes(["dense"], _checksum_sql("""
    (SELECT * FROM sm WHERE unit_id NOT IN (
       SELECT a.qid FROM nn1 a JOIN nn1 b ON a.nid = b.qid AND b.nid = a.qid WHERE a.nlabel <> a.qlabel))"""),
    _SMOTE + [("sm", "SELECT unit_id, y, x FROM dense UNION ALL SELECT unit_id, y, x FROM syn"),
              ("nn1", _KNN_ALL.format(src="sm", k=1))]), ["checksum"]))
def _res09(spark, sf):
    return _checksum(SM.smote_tomek(FX.dense_sensors(spark, sf)))


_PAIRS = """row_number() OVER (PARTITION BY a.unit_id ORDER BY list_sum(list_transform(list_zip(a.x, b.x),
                              lambda t: (t[1] - t[2]) * (t[1] - t[2]))), b.unit_id) - 1 AS slot"""
_N_NEW = "((SELECT count(*) FROM dense WHERE y = 0) - (SELECT count(*) FROM dense WHERE y = 1))"
_WITH_SYN = "(SELECT unit_id, y, x FROM dense UNION ALL SELECT unit_id, y, x FROM syn)"


def _near_all(m: int) -> str:
    """The m nearest rows of the whole table of every minority row, as majority counts."""
    return f"""SELECT qid, count(*) FILTER (WHERE nlabel <> 1) AS n_maj FROM (
      SELECT a.unit_id AS qid, b.y AS nlabel, {_PAIRS} FROM dense a JOIN dense b ON a.y = 1 AND a.unit_id <> b.unit_id)
      WHERE slot < {m} GROUP BY qid"""


def _synthetic(seeds: str) -> str:
    return f"""SELECT -(d.draw + 1) AS unit_id, 1 AS y, list_transform(list_zip(s.x, m.x), lambda t: t[1] + d.u * (t[2] - t[1])) AS x
      FROM draws d JOIN {seeds} s USING (srank) JOIN nn ON nn.qid = s.unit_id AND nn.slot = d.slot
      JOIN dense m ON m.unit_id = nn.nid"""


_BORDER = [_KNN_MIN,
           ("near10", _near_all(10)),
           ("danger", "SELECT unit_id, x FROM dense JOIN near10 ON unit_id = qid WHERE n_maj >= 5 AND n_maj < 10"),
           ("sr", f"SELECT unit_id, x, {_rank('unit_id', None)} AS srank FROM danger"),
           ("draws", f"""
             SELECT range AS draw, {h60("CAST(range AS VARCHAR) || ':s:42'")} % (SELECT count(*) FROM danger) + 1 AS srank,
                    CAST({h60("CAST(range AS VARCHAR) || ':n:42'")} % 5 AS INTEGER) AS slot,
                    CAST({h60("CAST(range AS VARCHAR) || ':u:42'")} % 1048576 AS DOUBLE) / 1048576 AS u
             FROM range({_N_NEW})"""),
           ("syn", _synthetic("sr"))]

_ADASYN = [_KNN_MIN,
           ("near5", _near_all(5)),
           ("quota", f"""SELECT qid, CAST(round_even(n_maj / 5.0 / (SELECT sum(n_maj / 5.0) FROM near5) * {_N_NEW}, 0) AS BIGINT) AS n_i
                         FROM near5"""),
           ("sr", f"SELECT unit_id, x, {_rank('unit_id', None)} AS srank FROM dense WHERE y = 1"),
           ("jobs", """SELECT srank, srank * ((SELECT max(n_i) FROM quota) + 1) + t AS draw
                       FROM (SELECT sr.srank, unnest(range(1, q.n_i + 1)) AS t FROM quota q JOIN sr ON sr.unit_id = q.qid
                             WHERE q.n_i > 0)"""),
           ("draws", f"""SELECT draw, srank, CAST({h60("CAST(draw AS VARCHAR) || ':n:42'")} % 5 AS INTEGER) AS slot,
                                CAST({h60("CAST(draw AS VARCHAR) || ':u:42'")} % 1048576 AS DOUBLE) / 1048576 AS u FROM jobs"""),
           ("syn", _synthetic("sr"))]


@register("res_06_borderline_smote", rsql(with_ctes(["dense"], _checksum_sql(_WITH_SYN), _BORDER), ["checksum"]))
def _res06(spark, sf):
    return _checksum(SM.borderline_smote(FX.dense_sensors(spark, sf)))


@register("res_07_adasyn", rsql(with_ctes(["dense"], _checksum_sql(_WITH_SYN), _ADASYN), ["checksum"]))
def _res07(spark, sf):
    return _checksum(SM.adasyn(FX.dense_sensors(spark, sf)))


@register("res_05_smote_class_counts", with_ctes(["dense"], """
  SELECT y, count(*) AS count FROM (SELECT y FROM dense UNION ALL SELECT y FROM syn) GROUP BY y""", _SMOTE))
def _smote_counts(spark, sf):
    return SM.smote(FX.dense_sensors(spark, sf)).groupBy("y").agg(F.count("*").alias("count"))



"""Queries over sources, data checks and sinks: wafer table scans, the
sensor text round trip (F9), examples, verification, preview, fingerprint."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import wafer as W
from ..session import shared_dir
from ..sinks import reports as R
from ..sources import fixtures as FX
from ..sources import sensor_text as ST
from ..sources import wafer_table as WT
from .catalog import ORACLE, register
from .common import round_doubles, rsql
from . import profile_queries  # noqa: F401  (their SQL is reused below)
from .oracle_fixtures import h, h60, with_ctes
from .sensor_queries import _three_way


# ------------------------------------------------------------- wafer table
@register("src_01_wafer_parquet_scan", with_ctes(["wafers"], "SELECT wafer_id, n_die, n_bad FROM wafers"))
def _src01(spark, sf):
    path = shared_dir(spark, "wafers")
    FX.wafers(spark, sf).write.mode("overwrite").parquet(path)
    return W.with_summary(WT.read_wafers(spark, path)).select("wafer_id", "n_die", "n_bad")


@register("src_01_wafer_json_nested_scan", with_ctes(["rwafers"], 'SELECT wafer_id, "rows", cols, n_bad FROM rwafers'))
def _src01j(spark, sf):
    path = shared_dir(spark, "wafers-json")
    r = FX.ragged_wafers(spark, sf)
    nested = F.transform(F.sequence(F.lit(0), F.col("rows") - 1),
                         lambda i: F.slice("cells", i * F.col("cols") + 1, F.col("cols")).cast("array<int>"))
    r.select("wafer_id", nested.alias("wafer_map")).write.mode("overwrite").json(path)
    back = WT.flatten_nested_maps(spark.read.schema("wafer_id long, wafer_map array<array<int>>").json(path))
    return W.with_summary(back).select("wafer_id", "rows", "cols", "n_bad")


@register("dq_01_verify", with_ctes(["wafers"], """
  SELECT count(*) AS n_rows, 1 AS n_missing, 'failure_raw' AS missing_columns, false AS ok,
         'missing columns: failure_raw; only ' || CAST(count(*) AS VARCHAR) || ' rows (< 800000)' AS message
  FROM wafers"""))
def _dq01(spark, sf):
    return WT.verify(FX.wafers(spark, sf))


@register("dq_05_preview", with_ctes(["wafers"], """
  SELECT wafer_id, lot_name, wafer_index, "rows", cols, '<array 24x24 tinyint>' AS cells
  FROM wafers ORDER BY wafer_id LIMIT 5"""))
def _dq05(spark, sf):
    return WT.preview(FX.wafers(spark, sf), 5)


@register("dq_07_fingerprint", with_ctes(["rwafers"], f"""
  SELECT count(*) AS n_rows, bit_xor({h60("row_text")}) AS xor60, sum({h("row_text")}) AS sum32 FROM (
    SELECT concat_ws('|', array_to_string(list(c.cell ORDER BY c.r, c.c), ','), CAST(any_value(w.cols) AS VARCHAR),
                     'lot' || CAST(c.wafer_id % 10 AS VARCHAR), CAST(any_value(w."rows") AS VARCHAR),
                     CAST(c.wafer_id AS VARCHAR), CAST(c.wafer_id // 10 AS VARCHAR)) AS row_text
    FROM rcells c JOIN rwafers w USING (wafer_id) GROUP BY c.wafer_id)"""))
def _dq07(spark, sf):
    return WT.fingerprint(FX.ragged_wafers(spark, sf))


@register("src_08_wafer_examples", with_ctes(["wafers"], """
  SELECT wafer_id, lot_name, n_die FROM wafers ORDER BY wafer_id LIMIT 3"""))
def _src08w(spark, sf):
    w = W.with_summary(FX.wafers(spark, sf))
    return w.orderBy("wafer_id").limit(3).select("wafer_id", "lot_name", "n_die")


@register("src_08_area_examples", with_ctes(["areas"], "SELECT part_id, area FROM areas ORDER BY part_id LIMIT 5"))
def _src08a(spark, sf):
    return FX.areas(spark, sf).orderBy("part_id").limit(5).select("part_id", "area")


@register("src_08_sensor_examples", with_ctes(["units"], """
  SELECT unit_id, any_value(y) AS y, count(*) FILTER (WHERE v IS NULL) AS n_missing
  FROM slong WHERE unit_id IN (SELECT unit_id FROM units ORDER BY unit_id LIMIT 5) GROUP BY unit_id"""))
def _src08s(spark, sf):
    s = FX.sensors(spark, sf).orderBy("unit_id").limit(5)
    return s.select("unit_id", "y", F.size(F.filter("x", lambda v: v.isNull())).cast("long").alias("n_missing"))


# ------------------------------------------------------- sensor text (F9)
_BAD_TS = "31/02/2024 00:00:00"


def _write_f9(spark, sf):
    base = shared_dir(spark, "sensor-text")
    s = FX.sensors(spark, sf)
    override = F.when(F.col("unit_id") % 50 == 49, F.concat(
        F.when(F.col("y") == 1, F.lit("1")).otherwise(F.lit("-1")), F.lit(" " + _BAD_TS)))
    ST.write_sensor_files(s, f"{base}/data", f"{base}/labels", "unit_id", override)
    return f"{base}/data", f"{base}/labels"


_F9 = ("f9", """
  SELECT CAST(row_number() OVER (ORDER BY unit_id) - 1 AS BIGINT) AS unit_id, y,
         CASE WHEN unit_id % 50 = 49 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
         n_missing, checksum
  FROM (SELECT unit_id, any_value(y) AS y, any_value(ts) AS ts, count(*) FILTER (WHERE v IS NULL) AS n_missing,
               sum(coalesce(v, 0) * (i + 1)) AS checksum FROM slong GROUP BY unit_id)""")


def _summ(df):
    return df.select("unit_id", "y", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                     F.size(F.filter("x", lambda v: v.isNull())).cast("long").alias("n_missing"),
                     F.aggregate(F.transform("x", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0),
                                 lambda a, b: a + b).alias("checksum"))


@register("src_02_05_sensor_text_roundtrip", rsql(with_ctes(["slong"], "SELECT * FROM f9", [_F9]), ["checksum"]))
def _src02(spark, sf):
    d, l_ = _write_f9(spark, sf)
    return round_doubles(_summ(ST.read_sensor_files(spark, d, l_)))


@register("src_03_label_parse", with_ctes(["slong"], """
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts IS NULL) AS n_null_ts,
         count(*) FILTER (WHERE y = 1) AS n_fail FROM f9""", [_F9]))
def _src03(spark, sf):
    d, l_ = _write_f9(spark, sf)
    lab = ST.read_sensor_labels(spark, l_)
    return lab.agg(F.count("*").alias("n_rows"), F.count_if(F.col("ts").isNull()).alias("n_null_ts"),
                   F.count_if(ST.remap_target(F.col("label_raw")) == 1).alias("n_fail"))


@register("dq_03_label_domain", with_ctes(["slong"], "SELECT '' AS bad_values, 0 AS n_bad FROM (SELECT 1) t"))
def _dq03(spark, sf):
    _, l_ = _write_f9(spark, sf)
    r = ST.label_report(ST.read_sensor_labels(spark, l_))
    return r.select(F.array_join("bad_values", ",").alias("bad_values"), F.col("n_bad").cast("int").alias("n_bad"))


@register("dq_04_orphan_lines", with_ctes(["slong"], "SELECT CAST(NULL AS BIGINT) AS line_idx WHERE false"))
def _dq04(spark, sf):
    d, l_ = _write_f9(spark, sf)
    return ST.orphans(ST.read_sensor_data(spark, d), ST.read_sensor_labels(spark, l_)).select("line_idx")


@register("dq_03_bad_label_values", with_ctes(["units"], """
  SELECT coalesce(string_agg(DISTINCT bad, ',' ORDER BY bad), '') AS bad_values, CAST(count(bad) AS INTEGER) AS n_bad
  FROM (SELECT CASE WHEN unit_id % 97 = 5 THEN '2' WHEN unit_id % 89 = 7 THEN 'null' END AS bad FROM units)"""))
def _dq03_bad(spark, sf):
    base, k = shared_dir(spark, "sensor-text-bad"), F.col("unit_id")
    bad = F.when(k % 97 == 5, F.lit('2 "01/01/2024 00:00:00"')).when(k % 89 == 7, F.lit('x "01/01/2024 00:00:00"'))
    ST.write_sensor_files(FX.sensors(spark, sf), f"{base}/data", f"{base}/labels", "unit_id", bad)
    r = ST.label_report(ST.read_sensor_labels(spark, f"{base}/labels"))
    return r.select(F.array_join("bad_values", ",").alias("bad_values"), F.col("n_bad").cast("int").alias("n_bad"))


@register("dq_04_short_label_file", with_ctes(["units"], """
  SELECT line_idx FROM (SELECT CAST(row_number() OVER (ORDER BY unit_id) - 1 AS BIGINT) AS line_idx FROM units)
  WHERE line_idx >= (SELECT count(*) FROM units WHERE unit_id % 10 <> 3)"""))
def _dq04_short(spark, sf):
    base, s = shared_dir(spark, "sensor-text-short"), FX.sensors(spark, sf)
    ST.write_sensor_files(s, f"{base}/data", f"{base}/labels", "unit_id")
    short = s.where("unit_id % 10 <> 3")
    ST.write_sensor_files(short, f"{base}/short-data", f"{base}/short-labels", "unit_id")
    data, labels = ST.read_sensor_data(spark, f"{base}/data"), ST.read_sensor_labels(spark, f"{base}/short-labels")
    return ST.orphans(data, labels).select("line_idx")


@register("flt_04_temporal_after_ingest", rsql(with_ctes(["slong"], """
  SELECT strftime(d.bin, '%Y-%m-%d') AS bin, coalesce(c.n, 0) AS n, CAST(coalesce(c.fails, 0) AS BIGINT) AS fails,
         CAST(c.fails AS DOUBLE) / nullif(c.n, 0) AS fail_rate
  FROM (SELECT unnest(generate_series(min(date_trunc('day', t)), max(date_trunc('day', t)), INTERVAL 1 DAY)) AS bin
        FROM (SELECT CAST(ts AS TIMESTAMP) AS t FROM f9 WHERE ts IS NOT NULL)) d
  LEFT JOIN (SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS bin, count(*) AS n, sum(y) AS fails
             FROM f9 WHERE ts IS NOT NULL GROUP BY 1) c ON c.bin = d.bin""", [_F9]), ["fail_rate"]))
def _flt04(spark, sf):
    d, l_ = _write_f9(spark, sf)
    s = ST.read_sensor_files(spark, d, l_)
    t = P.temporal_failure_rate(s.withColumnRenamed("y", "fail"))
    return round_doubles(t.withColumn("bin", F.date_format("bin", "yyyy-MM-dd")))


@register("src_04_csv_scoring_input", rsql(with_ctes(["slong"], """
  SELECT count(*) FILTER (WHERE v IS NULL) AS n_missing, sum(coalesce(v, 0) * (i + 1)) AS checksum
  FROM slong GROUP BY unit_id"""), ["checksum"]))
def _src04(spark, sf):
    path = shared_dir(spark, "scoring-csv")
    names = FX.sensor_names()
    s = FX.sensors(spark, sf)
    s.select(*[F.get("x", i).alias(n) for i, n in enumerate(names)]).write.mode("overwrite") \
        .option("header", True).csv(path)
    x = ST.read_scoring_input(spark, path)
    return round_doubles(x.select(
        F.size(F.filter("x", lambda v: v.isNull())).cast("long").alias("n_missing"),
        F.aggregate(F.transform("x", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0),
                    lambda a, b: a + b).alias("checksum")))


@register("snk_01_split_files", f"""
  SELECT split, count(*) AS count FROM ({ORACLE["spl_02_three_way_split"]}) GROUP BY split""")
def _snk01(spark, sf):
    paths = R.write_splits(_three_way(spark, sf), shared_dir(spark, "splits"))
    return spark.read.parquet(paths["data"]).groupBy("split").count()


@register("snk_02_03_reports_roundtrip", f"""
  SELECT n_samples, CAST(n_features AS BIGINT) AS n_features, n_fail FROM ({ORACLE["dq_06_dataset_summary"]})""")
def _snk02(spark, sf):
    base = shared_dir(spark, "reports")
    summary = P.dataset_summary(FX.sensors(spark, sf))
    R.write_json(summary, f"{base}/summary")
    R.write_csv(P.missingness(FX.sensors(spark, sf)), f"{base}/missingness")
    R.write_tables({"class_balance": P.class_balance(FX.sensors(spark, sf))}, f"{base}/tables")
    return spark.read.json(f"{base}/summary").select("n_samples", "n_features", "n_fail")

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fabspark.operators import score as S
from fabspark.session import shared_dir
from fabspark.sources import fixtures as FX
from fabspark.sources import sensor_text as ST
from fabspark.sources import wafer_table as WT


def _write_lines(spark, path, lines, parts=1):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(parts).write.text(path)


def test_text_files_parse_align_and_report(spark):
    base = shared_dir(spark, "t-ingest")
    _write_lines(spark, f"{base}/d", ["1.5 NaN 2", "nan  3 4", "", "7 8 x"])
    _write_lines(spark, f"{base}/l", ['-1 "01/02/2024 10:00:00"', "1 31/02/2024 00:00:00", "1"])
    df = ST.read_sensor_files(spark, f"{base}/d", f"{base}/l").orderBy("unit_id").collect()
    assert [r["x"] for r in df] == [[1.5, None, 2.0], [None, 3.0, 4.0], [7.0, 8.0, None]]
    assert [r["y"] for r in df] == [0, 1, 1]
    assert str(df[0]["ts"]) == "2024-02-01 10:00:00" and df[1]["ts"] is None and df[2]["ts"] is None


def test_line_index_across_many_files(spark):
    base = shared_dir(spark, "t-lines")
    spark.range(1000).select(F.col("id").cast("string").alias("value")).orderBy("id").repartitionByRange(7, "value") \
        .sortWithinPartitions("value").write.text(f"{base}/d")
    got = ST.read_lines(spark, f"{base}/d").orderBy("line_idx").collect()
    vals = [r["value"] for r in got]
    assert [r["line_idx"] for r in got] == list(range(1000)) and vals == sorted(vals)


def test_count_mismatch_and_bad_labels(spark):
    base = shared_dir(spark, "t-mismatch")
    _write_lines(spark, f"{base}/d", ["1 2", "3 4"])
    _write_lines(spark, f"{base}/l", ["1 01/01/2024 00:00:00", "0 01/01/2024 00:00:00", "1"])
    with pytest.raises(ValueError):
        ST.read_sensor_files(spark, f"{base}/d", f"{base}/l")
    lab = ST.read_sensor_labels(spark, f"{base}/l")
    rep = ST.label_report(lab).first()
    assert rep["bad_values"] == ["0"] and rep["n_bad"] == 1
    assert [r["line_idx"] for r in ST.orphans(ST.read_sensor_data(spark, f"{base}/d"), lab).collect()] == [2]
    with pytest.raises(Exception):
        lab.select(ST.remap_target(F.col("label_raw"), strict=True)).collect()


def test_wafer_table_errors_and_verify(spark):
    with pytest.raises(FileNotFoundError):
        WT.read_wafers(spark, "/nonexistent/wafers")
    w = FX.wafers(spark, SF01)
    with pytest.raises(ValueError):
        WT.require_columns(w.drop("cells"), WT.REQUIRED_COLUMNS)
    r = WT.verify(w, min_rows=10).first()
    assert r["missing_columns"] == "failure_raw" and not r["ok"]
    a = WT.fingerprint(w).first()
    b = WT.fingerprint(w.repartition(5)).first()
    assert tuple(a) == tuple(b)


def test_scoring_inputs_from_requests(spark):
    rows = [(1, '{"features": [[1,2,3],[4,5,6]]}'), (2, '{"features": [1,2]}'),
            (3, '{"wafer_maps": [[[0,1],[1,2]], [[1,1,1],[2,2,2]]], "img_size": 8}')]
    routed = S.route(spark.createDataFrame(rows, "request_id long, payload string"))
    sr = {(r["request_id"], r["row_idx"]): r for r in S.sensor_rows(routed, 3).collect()}
    assert sr[(1, 1)]["x"] == [4.0, 5.0, 6.0] and sr[(1, 0)]["error"] is None
    assert sr[(2, 0)]["error"] == "expected 3 features, got 2"
    wr = sorted((r["map_idx"], r["rows"], r["cols"], r["img_size"]) for r in S.wafer_rows(routed).collect())
    assert wr == [(0, 2, 2, 8), (1, 2, 3, 8)]


def test_align_columns_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "b double, a double, c double")
    assert S.align_columns(df, ["a", "b", "c"]).first()["x"] == [2.0, 1.0, 3.0]
    with pytest.warns(UserWarning):
        assert S.align_columns(df, ["p", "q", "r"]).first()["x"] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        S.align_columns(df, ["a", "b", "c", "d"])

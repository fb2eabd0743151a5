"""Inputs that the derived fixtures never hold: malformed maps, requests, small classes, odd files."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fabspark import session
from fabspark.operators import cumulative, quantiles, score, smote, wafer
from fabspark.sources import sensor_text


def test_window_kernel_leaves_malformed_maps_out(spark):
    good = [1] * 16
    rows = [(1, 4, 4, good), (2, 4, 4, [1] * 8), (3, 4, 4, None), (4, 4, 4, [1] * 15 + [None]), (5, None, 4, good)]
    maps = spark.createDataFrame(rows, "wafer_id long, rows int, cols int, cells array<tinyint>").coalesce(1)
    got = {r["window"]: (r["n_valid"], r["n_yield"]) for r in wafer.count_windows(maps, sizes=(1, 2)).collect()}
    assert got == {1: (16, 16), 2: (4, 4)}


def test_smote_needs_more_minority_rows_than_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i < 4), [float(v) for v in rng.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "unit_id long, y int, x array<double>")
    for strategy in (smote.smote, smote.borderline_smote, smote.adasyn):
        with pytest.raises(ValueError, match="minority"):
            strategy(df, k=5)
    counts = {r["y"]: r["count"] for r in smote.smote(df, k=3).groupBy("y").count().collect()}
    assert counts == {0: 36, 1: 36}


def test_resampling_keeps_string_ids_and_unique_draws(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{i}", int(i % 5 == 0), [float(v) for v in rng.normal(size=3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "unit_id string, y int, x array<double>")
    for strategy in (smote.smote, smote.adasyn):
        ids = [r["unit_id"] for r in strategy(df, k=3).collect()]
        assert len(ids) == len(set(ids)) > 100


def test_quantiles_close_over_many_magnitudes(spark):
    values = [10.0 ** e for e in range(-300, 300, 4)] + [-(10.0 ** e) for e in range(-300, 300, 4)] + [0.0, float("inf")]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    got = quantiles.exact_quantiles(df, ["k"], "v", [0.25, 0.5], max_collect=3).collect()
    finite = sorted(values)
    for r in got:
        h = (len(finite) - 1) * r["p"]
        lo, hi = finite[int(np.floor(h))], finite[int(np.ceil(h))]
        assert r["q"] == pytest.approx(lo + (h - np.floor(h)) * (hi - lo))


def test_part_files_are_numbered_by_number(spark, tmp_path):
    for name, line in (("part-99999.txt", "1 2"), ("part-100000.txt", "3 4"), ("part-00007.txt", "0 0")):
        (tmp_path / name).write_text(line + "\n")
    got = [r["value"] for r in sensor_text.read_lines(spark, str(tmp_path)).orderBy("line_idx").collect()]
    assert got == ["0 0", "1 2", "3 4"]


def test_malformed_yield_requests_get_error_rows(spark):
    payloads = ['{"target_yield":"abc"}', '{"domain":"yield_curve"}', '{"area":[]}', '{"area":"x"}', '{"area":4}']
    requests = spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string")
    params = spark.createDataFrame([("poisson", 0.05, None, True)], "model string, d0 double, alpha double, is_best boolean")
    routed = score.route(requests).withColumn("domain", F.lit("yield_curve"))
    got = {r["request_id"]: r for r in score.yield_requests(routed, params).collect()}
    assert sorted(got) == list(range(5))
    assert all(got[i]["error"] for i in range(4)) and got[4]["error"] is None and got[4]["yield"] is not None


def test_sensor_records_are_read_by_position(spark):
    payloads = ['{"rows":[{"a":1.0,"b":2.0},{"a":3.0,"b":4.0}]}', '{"features":[5,6]}', '{"rows":[[7,8]]}', '{"rows":[{"a":1.0}]}']
    routed = spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string").withColumn("domain", F.lit("secom"))
    got = {(r["request_id"], r["row_idx"]): (r["x"], r["error"]) for r in score.sensor_rows(routed, 2).collect()}
    assert [got[k][0] for k in ((0, 0), (0, 1), (1, 0), (2, 0))] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]
    assert got[(3, 0)][1] and not got[(0, 0)][1]


def test_a_shared_folder_must_be_named_off_a_local_session(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(), "x")


def test_wafer_requests_that_are_no_grid_get_error_rows(spark):
    payloads = ['{"wafer_map":[[0,1],[2,1]],"img_size":8}', '{"wafer_map":[[0,1],[1]]}', '{"wafer_map":"x","domain":"wafer_cnn"}',
                '{"wafer_maps":[[[1]],[[1,2],[]]]}']
    requests = spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string")
    rows = score.wafer_rows(score.route(requests)).collect()
    got = {(r["request_id"], r["map_idx"]): (r["cells"], r["img_size"]) for r in rows if r["error"] is None}
    assert got == {(0, 0): ([0, 1, 2, 1], 8), (3, 0): ([1], None)}
    assert {(r["request_id"], r["map_idx"]) for r in rows if r["error"]} == {(1, 0), (2, None), (3, 1)}


def test_sensor_requests_never_vanish(spark):
    payloads = ['{"rows":[{"a":1,"b":2,"c":"x"}]}', '{"rows":[{"a":1,"b":2,"c":"3.5"}]}', '{"features":"abc"}', '{"rows":[]}', '{"features":[1,2,null]}',
                '{"features":[[1,2,3],[4,"y",6]]}', '{"rows":"{"}', "{}"]
    routed = spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string").withColumn("domain", F.lit("secom"))
    got = {}
    for r in score.sensor_rows(routed, 3, trained=["a", "b", "c"]).collect():
        got.setdefault(r["request_id"], []).append((r["x"], r["error"]))
    assert sorted(got) == list(range(len(payloads)))
    assert got[0][0][1] == "feature values must be numbers" and got[1] == [([1.0, 2.0, 3.5], None)]
    assert got[4] == [([1.0, 2.0, None], None)]
    assert [e for _, e in got[5]] == [None, "feature values must be numbers"]
    assert all(got[i][0][1] for i in (2, 3, 6, 7))


def test_wafer_requests_never_abort(spark):
    payloads = ['{"wafer_map":[[0,1],[1,2]],"img_size":"abc"}', '{"wafer_map":[[0,300],[1,2]]}', '{"wafer_map":[[0,1],[1,2]],"img_size":3}',
                '{"wafer_map":[[0,1],[1,2]]}', '{"wafer_map":[[0,1],[1,2]],"img_size":-4}', '{"wafer_maps":[]}']
    routed = spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string").withColumn("domain", F.lit("wafer_cnn"))
    rows = {r["request_id"]: r for r in score.wafer_rows(routed).collect()}
    assert sorted(rows) == list(range(len(payloads)))
    assert {i for i, r in rows.items() if r["error"]} == {0, 1, 4, 5} and rows[2]["img_size"] == 3 and rows[3]["img_size"] is None


def test_resize_by_way_of_a_size_in_a_column(spark):
    rng = np.random.default_rng(0)
    maps = [(i, r, c, v, [int(x) for x in rng.integers(0, 3, r * c)]) for i, (r, c, v) in enumerate([(5, 7, 3), (6, 4, 9), (8, 8, None), (3, 3, 1)])]
    df = spark.createDataFrame(maps, "wafer_id long, rows int, cols int, img_size int, cells array<tinyint>")
    got = {r["wafer_id"]: r["x"] for r in wafer.resized(df, 4, "img_size").collect()}

    def near(grid, size):
        h, w = grid.shape
        return np.array([[grid[min(i * h // size, h - 1), min(j * w // size, w - 1)] for j in range(size)] for i in range(size)])
    for i, r, c, v, cells in maps:
        grid = np.array(cells).reshape(r, c)
        want = near(near(grid, v) if v else grid, 4)
        assert got[i] == (want / 2).ravel().tolist()


def test_answers_of_all_branches(spark):
    payloads = ['{"area":[4,1]}', '{"features":[1,2]}', '{"features":[[1,2],[3,4]]}', '{"wafer_map":[[0,1],[1,2]]}', "{}", "not json", '{"features":[1]}']
    requests = spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string")
    params = spark.createDataFrame([("poisson", 0.05, None, True)], "model string, d0 double, alpha double, is_best boolean")

    class Model:
        class prep:
            names_in = ["a", "b"]

        @staticmethod
        def predict_frame(df):
            return df.withColumns({"fail_proba": F.get("x", 0) / 10, "decision": F.get("x", 0) > 2, "label": F.lit("pass")})
    branches = {"yield_curve": score.yield_branch(params), "secom": score.sensor_branch(Model),
                "wafer_cnn": score.wafer_branch(lambda m: m.withColumns({"pattern": F.lit("none"), "confidence": F.get("x", 3).cast("double")}), 2)}
    got = {r["request_id"]: r for r in score.answer(score.route(requests), branches).collect()}
    assert sorted(got) == list(range(len(payloads)))
    for i, r in got.items():
        assert r["results"] and all((x["result"] is None) != (x["error"] is None) for x in r["results"]), i
    assert ['"area":4.0' in got[0]["results"][0]["result"], '"area":1.0' in got[0]["results"][1]["result"]] == [True, True]
    assert ['"fail_proba":0.1' in got[2]["results"][0]["result"], '"fail_proba":0.3' in got[2]["results"][1]["result"]] == [True, True]
    assert '"confidence":1.0' in got[3]["results"][0]["result"]
    assert got[4]["results"][0]["error"] and got[5]["results"][0]["error"] and got[6]["results"][0]["error"].startswith("expected 2")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_running_sums_keep_groups_without_key(spark, monkeypatch, limit):
    monkeypatch.setattr(cumulative, "CUTS_BROADCAST", limit)
    rows = [(None if i % 3 == 0 else i % 3, float((i * 7) % 31), 1) for i in range(120)] + [(5, None, 1), (5, 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, v double, n int")
    got = cumulative.running_sums(df, "v", ["n"], ["g"], descending=False, target_rows=10, tie_cols=["n"])
    per = {r["g"]: (r["rows"], r["top"]) for r in got.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.max("cum_n").alias("top")).collect()}
    assert per == {None: (40, 40), 1: (40, 40), 2: (40, 40), 5: (2, 2)}

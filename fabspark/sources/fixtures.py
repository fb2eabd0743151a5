"""Derived fixtures F1..F9: wafer maps, sensor matrix, scores, ... built from
the driver's tables with deterministic rules (see FIXTURES.md).

Every derivation is a plain DataFrame plan over a whole table, so the work
grows with the input. Each rule uses only functions that DuckDB also has, so
the same fixture can be rebuilt in SQL for the oracle (``plans/oracle_sql``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import h32
from .tables import read_table

GRID = 24                   # wafer edge (cells) of the F1 grid
RADIUS2 = 144.0             # die iff (r-11.5)^2 + (c-11.5)^2 <= 144
N_SENSORS = 64              # F2 width
N_CLASSES = 10              # F4 classes

# F6 failure-pattern names (index = h(c_custkey) % 12; >= 8 -> 'none').
PATTERN_NAMES = ["Center", "Donut", "Edge-Loc", "Edge-Ring", "Loc", "Near-full", "Random", "Scratch"]


def _is_die(r: Column, c: Column) -> Column:
    half = (GRID - 1) / 2.0
    return (r - half) * (r - half) + (c - half) * (c - half) <= RADIUS2


# --------------------------------------------------------------------------- F1
def _supplier_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(wafer_id, bad array<int>)``: flat 24x24 positions of bad dies per supplier.

    A single aggregation per supplier (map-side partial collect_set of at most
    576 positions per wafer) — a hot supplier never lands whole in one task.
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_suppkey", "l_partkey", "l_orderkey", "l_returnflag", "l_quantity"])
    bad_pos = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45),
                     (F.col("l_partkey") % GRID) * GRID + F.col("l_orderkey") % GRID).cast("int")
    return li.groupBy(F.col("l_suppkey").cast("long").alias("wafer_id")).agg(F.collect_set(bad_pos).alias("bad"))


def _grid_cells(rows: Column, cols: Column) -> Column:
    """Row-major ``rows x cols`` crop of the 24x24 grid, computed from scalars
    and the small ``bad`` set only (no reference to another array column, so
    no per-element re-evaluation after projection collapsing)."""
    def cell(k):
        r = F.floor(k / cols)
        c = k % cols
        return (F.when(_is_die(r, c),
                       F.when(F.array_contains(F.col("bad"), (r * GRID + c).cast("int")), F.lit(2)).otherwise(F.lit(1)))
                .otherwise(F.lit(0)).cast("tinyint"))
    return F.transform(F.sequence(F.lit(0), (rows * cols - 1).cast("int")), cell)


def _wafer_frame(per: DataFrame, rows: Column, cols: Column) -> DataFrame:
    return per.select(
        "wafer_id",
        F.concat(F.lit("lot"), (F.col("wafer_id") % 10).cast("string")).alias("lot_name"),
        F.floor(F.col("wafer_id") / 10).cast("int").alias("wafer_index"),
        rows.alias("rows"), cols.alias("cols"),
        _grid_cells(rows, cols).alias("cells"))


def wafers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one 24x24 wafer per supplier; bad cells from returned large lineitems."""
    return _wafer_frame(_supplier_defects(spark, sf_dir), F.lit(GRID), F.lit(GRID))


def ragged_wafers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1b: each wafer cropped to (20 + id%5) x (20 + id%3) — ragged sizes."""
    rows = (F.lit(20) + F.col("wafer_id") % 5).cast("int")
    cols = (F.lit(20) + F.col("wafer_id") % 3).cast("int")
    return _wafer_frame(_supplier_defects(spark, sf_dir), rows, cols)


def cells_long(wafers_df: DataFrame) -> DataFrame:
    """Long form ``(wafer_id, r, c, cell)`` of a wafer table."""
    return (wafers_df
            .select("wafer_id", "cols", F.posexplode("cells").alias("k", "cell"))
            .select("wafer_id",
                    F.floor(F.col("k") / F.col("cols")).cast("int").alias("r"),
                    (F.col("k") % F.col("cols")).cast("int").alias("c"),
                    F.col("cell").cast("int").alias("cell")))


# --------------------------------------------------------------------------- F2
def _missing_pct(i: Column) -> Column:
    return F.when(i % 16 == 7, 60).when(i % 8 == 3, 20).otherwise(4)


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(unit_id, y, ts, x array<double>[64])`` with planted missing and dead slots."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    key = lambda i: h32(F.concat(F.col("vec_id").cast("string"), F.lit(":"), i.cast("string")))
    x = F.transform(
        F.sequence(F.lit(0), F.lit(N_SENSORS - 1)),
        lambda i: F.when(key(i) % 100 < _missing_pct(i), F.lit(None).cast("double"))
                   .when(i % 32 == 31, F.lit(1.0))
                   .otherwise(F.get(F.col("embedding"), i).cast("double")))
    return emb.select(
        F.col("vec_id").alias("unit_id"),
        (F.col("label") == 0).cast("int").alias("y"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600)).alias("ts"),
        x.alias("x"))


def sensor_names(n: int = N_SENSORS) -> list[str]:
    return [f"feature_{i:03d}" for i in range(n)]


# --------------------------------------------------------------------------- F3
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, y, score)`` — binary labels with heavily tied scores."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    y = (F.col("event_type") == "error").cast("int")
    return ev.select(F.col("event_id").alias("id"), y.alias("y"),
                     ((h32("event_id") % 71 + 29 * y).cast("double") / 100.0).alias("score"))


# --------------------------------------------------------------------------- F4
def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, y, z array<double>[10])``: logit k is the sum of the embedding slots k, k + 10, ... and a bump on the true class."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    z = F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)),
                    lambda k: F.aggregate(F.filter("embedding", lambda _, j: j % N_CLASSES == k), F.lit(0.0),
                                          lambda s, v: s + v.cast("double"))
                    + F.when(k == F.col("label"), 0.15).otherwise(0.0))
    return emb.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"), z.alias("z"))


# --------------------------------------------------------------------------- F5
def timeline(spark: SparkSession, sf_dir: str, drop_days: bool = False) -> DataFrame:
    """``(ts, fail, value)``; F5b (``drop_days``) removes days with dayofmonth % 7 = 3."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    out = ev.select("ts", (F.col("event_type") == "error").cast("int").alias("fail"), "value")
    if drop_days:
        out = out.filter(F.dayofmonth("ts") % 7 != 3)
    return out


# --------------------------------------------------------------------------- F6
def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(wafer_id, failure_raw array<array<string>>)`` in the reference's nested shapes."""
    cu = read_table(spark, sf_dir, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    idx = (h32(k) % 12).cast("int")
    name = F.when(idx < len(PATTERN_NAMES),
                  F.element_at(F.array(*[F.lit(n) for n in PATTERN_NAMES]), idx + 1)).otherwise(F.lit("none"))
    name = F.when(k % 5 == 0, F.concat(F.lit(" "), name)).otherwise(name)
    raw = (F.when(k % 11 == 0, F.array().cast("array<array<string>>"))
            .when(k % 11 == 1, F.lit(None).cast("array<array<string>>"))
            .when(k % 11 == 2, F.array(F.array(F.lit(""))))
            .otherwise(F.array(F.array(name))))
    return cu.select(k.alias("wafer_id"), raw.alias("failure_raw"))


# --------------------------------------------------------------------------- F7
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(part_id, area, target)`` questions for forward / inverse yield."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    return p.select(F.col("p_partkey").alias("part_id"),
                    F.col("p_size").cast("double").alias("area"),
                    (F.lit(0.5) + (F.col("p_partkey") % 50).cast("double") / 100.0).alias("target"))


# F7 model parameters.
F7_PARAMS = {"poisson": {"D0": 0.0418}, "murphy": {"D0": 0.0483},
             "negative_binomial": {"D0": 0.06, "alpha": 1.8}}


# --------------------------------------------------------------------------- F8
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, payload)`` JSON requests for the router, from events.props.k."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    wide = F.concat(F.lit('{"features":['), F.repeat(F.lit("1,"), 119), F.lit("1]}"))
    by6 = (F.when(k % 6 == 0, F.concat(F.lit('{"area":'), k.cast("string"), F.lit("}")))
            .when(k % 6 == 1, F.lit('{"target_yield":0.9}'))
            .when(k % 6 == 2, F.lit('{"wafer_map":[[0,1],[1,2]]}'))
            .when((k % 6 == 3) & (k >= 50), wide)
            .when(k % 6 == 3, F.lit('{"features":[1,2,3]}'))
            .when(k % 6 == 4, F.lit('{"domain":"yield_curve","area":4}'))
            .otherwise(F.lit('{"wafer_map":[0,1],"target_yield":0.8}')))
    payload = F.when(k % 7 == 0, F.lit("{}")).otherwise(by6)
    return ev.select(F.col("event_id").alias("request_id"), payload.alias("payload"))


def sensor_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, payload)``: every F2 row as a scoring request (ids -1, -2, ..):
    a list of 64 values, for every fifth unit a record by name in reverse order,
    for every eleventh one value too few."""
    s = sensors(spark, sf_dir)
    k = F.col("unit_id")
    record = F.map_from_arrays(F.array(*map(F.lit, sensor_names()[::-1])), F.reverse("x"))
    payload = (F.when(k % 11 == 0, F.to_json(F.struct(F.slice("x", 1, N_SENSORS - 1).alias("features"))))
                .when(k % 5 == 0, F.to_json(F.struct(F.array(record).alias("rows"))))
                .otherwise(F.to_json(F.struct(F.col("x").alias("features")))))
    return s.select((-k - 1).alias("request_id"), payload.alias("payload"))


def sparse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, payload)``: every F2 row as a record that holds its present values only."""
    s = sensors(spark, sf_dir)
    record = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, sensor_names())), "x"), lambda k, v: v.isNotNull())
    return s.select(F.col("unit_id").alias("request_id"), F.to_json(F.struct(F.array(record).alias("rows"))).alias("payload"))


def wafer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, payload)``: every F1b map as a 2-D grid (ids -1, -2, ..)."""
    grid = F.transform(F.sequence(F.lit(0), F.col("rows") - 1),
                       lambda i: F.slice("cells", i * F.col("cols") + 1, F.col("cols")).cast("array<int>"))
    return ragged_wafers(spark, sf_dir).select((-F.col("wafer_id") - 1).alias("request_id"),
                                               F.to_json(F.struct(grid.alias("wafer_map"))).alias("payload"))


def dense_sensors(spark: SparkSession, sf_dir: str, width: int = N_SENSORS) -> DataFrame:
    """``(unit_id, y, x array<double>[width])`` without missing values (all
    ``width`` embedding dimensions): the input of the k-NN based resamplers."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    x = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.col("embedding"), i).cast("double"))
    return emb.select(F.col("vec_id").alias("unit_id"), (F.col("label") == 0).cast("int").alias("y"), x.alias("x"))

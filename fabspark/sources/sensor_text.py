"""Whitespace-delimited sensor text files (data + labels), as the public
sensor dataset ships them, read and written with Spark.

* data file:   one unit per line, values separated by whitespace, ``NaN`` /
  ``nan`` / empty = missing; no header; names generated (``feature_000``...)
* labels file: ``<label> <dd/mm/yyyy> <HH:MM:SS>`` per line, label -1 (pass)
  or 1 (fail); a timestamp only when three tokens exist, unparseable -> NULL.

The two files are aligned by line position. Line positions come from the
file source's hidden ``_metadata`` (file path, block start) plus a
within-partition monotonically increasing id: a tiny per-block table of
counts gives each block's offset, so the index is exact without a global
sort or ``zipWithIndex``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File formats.
TS_FORMAT = "dd/MM/yyyy HH:mm:ss"
MISSING_TS = "01/01/1970 00:00:00"
MISSING_TOKEN = "NaN"
LABELS = (-1, 1)


def read_lines(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """``(line_idx, value)`` with the exact 0-based line position across the
    files of ``path``; blank lines are skipped (as whitespace-table readers do)
    and the remaining lines renumbered densely."""
    raw = (spark.read.text(path)
           .select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                   F.monotonically_increasing_id().alias("_m")))
    blocks = raw.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    # one row per file block: a small table, ordered by (file, block start)
    part = F.regexp_extract("_f", r"part-(\d+)", 1).try_cast("long")    # part-100000 comes after part-99999
    w = Window.orderBy(part, "_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = blocks.select("_f", "_b", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = (raw.join(offs, ["_f", "_b"])
           .select((F.col("_off") + F.col("_m") - F.col("_m0")).alias("line_idx"), "value"))
    if skip_blank:
        blank = F.trim("value") == ""
        if out.filter(blank).limit(1).count():          # renumber only when blank lines exist
            from ..operators.cumulative import running_sums
            kept = out.filter(~blank).withColumn("_one", F.lit(1).cast("long"))
            out = running_sums(kept, "line_idx", ["_one"], descending=False).select(
                (F.col("cum__one") - 1).alias("line_idx"), "value")
    return out


def parse_values(value: Column) -> Column:
    """SRC-02: whitespace tokens -> array<double>; NaN/nan/'' and non-numbers -> NULL."""
    toks = F.split(F.trim(value), r"\s+")
    return F.transform(toks, lambda t: F.nanvl(t.try_cast("double"), F.lit(None).cast("double")))


def read_sensor_data(spark: SparkSession, path: str) -> DataFrame:
    """``(line_idx, x array<double>)``."""
    return read_lines(spark, path).select("line_idx", parse_values(F.col("value")).alias("x"))


def read_sensor_labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: ``(line_idx, label_raw int, ts timestamp)``; quotes stripped;
    ``try_to_timestamp`` (never ``to_timestamp``, which raises under ANSI)."""
    toks = F.split(F.trim(F.regexp_replace("value", '"', "")), r"\s+")
    ts = F.when(F.size(toks) >= 3, F.try_to_timestamp(F.concat_ws(" ", F.get(toks, 1), F.get(toks, 2)),
                                                      F.lit(TS_FORMAT)))
    return read_lines(spark, path).select("line_idx", F.get(toks, 0).try_cast("int").alias("label_raw"),
                                          ts.alias("ts"))


def label_report(labels: DataFrame) -> DataFrame:
    """DQ-03: values outside {-1, 1} (one row: offending values, count)."""
    bad = ~F.col("label_raw").isin(list(LABELS)) | F.col("label_raw").isNull()
    return labels.agg(F.sort_array(F.collect_set(F.when(bad, F.coalesce(F.col("label_raw").cast("string"),
                                                                          F.lit("null"))))).alias("bad_values"),
                      F.count_if(bad).alias("n_bad"))


def remap_target(label: Column, strict: bool = False) -> Column:
    """PRJ-03: -1 -> 0 (pass), 1 -> 1 (fail); other values NULL, or an error when strict."""
    out = F.when(label == -1, 0).when(label == 1, 1)
    if strict:
        out = F.when(label.isin(list(LABELS)), out).otherwise(
            F.raise_error(F.concat(F.lit("unexpected label value "), label.cast("string"))).cast("int"))
    return out


def align(data: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """SRC-05 / JON-01 / DQ-04: join data and labels on line position.
    With ``strict`` the two line counts must be equal (checked with two counts)."""
    if strict:
        nd, nl = data.count(), labels.count()
        if nd != nl:
            raise ValueError(f"data has {nd} rows but labels has {nl}")
    return (data.join(labels, "line_idx")
            .select(F.col("line_idx").alias("unit_id"), remap_target(F.col("label_raw")).alias("y"), "ts", "x"))


def orphans(data: DataFrame, labels: DataFrame) -> DataFrame:
    """DQ-04: line positions present in only one of the two files."""
    return (data.select("line_idx", F.lit(True).alias("in_data"))
            .join(labels.select("line_idx", F.lit(True).alias("in_labels")), "line_idx", "full_outer")
            .filter(F.col("in_data").isNull() | F.col("in_labels").isNull()))


def read_sensor_files(spark: SparkSession, data_path: str, labels_path: str) -> DataFrame:
    """SRC-02/03/05: the canonical ``(unit_id, y, ts, x)`` frame."""
    return align(read_sensor_data(spark, data_path), read_sensor_labels(spark, labels_path))


def format_data_lines(x: Column) -> Column:
    return F.concat_ws(" ", F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit(MISSING_TOKEN))))


def format_label_lines(y: Column, ts: Column) -> Column:
    lab = F.when(y == 1, F.lit("1")).otherwise(F.lit("-1"))
    return F.concat_ws(" ", lab, F.coalesce(F.date_format(ts, TS_FORMAT), F.lit(MISSING_TS)))


def write_sensor_files(sensors: DataFrame, data_path: str, labels_path: str, order_col: str = "unit_id",
                       ts_override: Column | None = None) -> None:
    """SRC-07: the normalised flat layout (space separated, ``NaN``, missing
    timestamps as 01/01/1970). Rows are written in ``order_col`` order
    (a range-partitioned sort; part files are in global order)."""
    s = sensors.orderBy(order_col)
    s.select(format_data_lines(F.col("x")).alias("value")).write.mode("overwrite").text(data_path)
    lab = format_label_lines(F.col("y"), F.col("ts"))
    if ts_override is not None:
        lab = F.coalesce(ts_override, lab)
    s.select(lab.alias("value")).write.mode("overwrite").text(labels_path)


def read_scoring_input(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """SRC-04: ``.data``/``.txt`` -> whitespace layout; anything else -> CSV
    with a header (all columns read as double)."""
    if path.endswith((".data", ".txt")):
        return read_sensor_data(spark, path)
    df = spark.read.option("header", True).csv(path)
    cols = names or df.columns
    return df.select(F.array(*[F.col(f"`{c}`").try_cast("double") for c in cols]).alias("x"))


def pick_column(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """SRC-06: first case-insensitive match of any candidate; else the first
    column when required (driver-side, on the schema only)."""
    low = {c.lower(): c for c in columns}
    for cand in candidates:
        if cand.lower() in low:
            return low[cand.lower()]
    if required and columns:
        return columns[0]
    return None

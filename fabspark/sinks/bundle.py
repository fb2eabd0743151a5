"""Model bundle save/load (MDL-16, SNK-04).

A bundle is one row per group: schema version, best model, reference die
area, a map of model -> (params, success, scores), metadata and a training
timestamp. It is written as JSON (one file per partition) to a shared
location and read back with a fixed schema, keeping only the supported
schema version.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

MODEL_ENTRY = T.StructType([
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("success", T.BooleanType()),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
])


def bundle_schema(group_fields: list[T.StructField] | None = None) -> T.StructType:
    return T.StructType(list(group_fields or []) + [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("best_model", T.StringType()),
        T.StructField("ref_die_area_mm2", T.DoubleType()),
        T.StructField("models", T.MapType(T.StringType(), MODEL_ENTRY)),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("trained_at", T.StringType()),
    ])


def build_bundle(fits_scored: DataFrame, group_cols=(), ref_die_area_mm2: float = 1.0,
                 metadata: dict[str, str] | None = None) -> DataFrame:
    """``fits_scored`` = fits left-joined to leaderboard scores (JON-02)."""
    group_cols = list(group_cols)
    params = F.map_from_arrays(
        F.when(F.col("alpha").isNull(), F.array(F.lit("D0"))).otherwise(F.array(F.lit("D0"), F.lit("alpha"))),
        F.when(F.col("alpha").isNull(), F.array("d0")).otherwise(F.array("d0", "alpha")))
    scores = F.when(F.col("rank").isNotNull(), F.create_map(
        F.lit("rmse"), F.col("rmse"), F.lit("weighted_rmse"), F.col("weighted_rmse"),
        F.lit("r2"), F.col("r2"), F.lit("aic"), F.col("aic"), F.lit("bic"), F.col("bic")))
    entry = F.struct(params.alias("params"), F.col("success"), scores.alias("scores"))
    md = F.create_map(*[x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))]) \
        if metadata else F.create_map().cast("map<string,string>")
    return (fits_scored.groupBy(*group_cols)
            .agg(F.map_from_entries(F.collect_list(F.struct("model", entry))).alias("models"),
                 F.min_by("model", F.col("rank")).alias("best_model"))
            .select(*group_cols, F.lit(SCHEMA_VERSION).alias("schema_version"), "best_model",
                    F.lit(float(ref_die_area_mm2)).alias("ref_die_area_mm2"), "models",
                    md.alias("metadata"),
                    F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("trained_at")))


def save_bundle(bundle: DataFrame, path: str) -> str:
    bundle.write.mode("overwrite").json(path)
    return path


def load_bundle(spark: SparkSession, path: str, group_fields: list[T.StructField] | None = None) -> DataFrame:
    df = spark.read.schema(bundle_schema(group_fields)).json(path)
    return df.filter(F.col("schema_version") == SCHEMA_VERSION)


def bundle_params(bundle: DataFrame, group_cols=()) -> DataFrame:
    """Long form ``(group..., model, d0, alpha, is_best)`` of successful models."""
    e = bundle.select(*group_cols, "best_model", F.explode("models").alias("model", "m"))
    return (e.filter(F.col("m.success"))
            .select(*group_cols, "model", F.col("m.params")["D0"].alias("d0"),
                    F.col("m.params")["alpha"].alias("alpha"),
                    (F.col("model") == F.col("best_model")).alias("is_best")))

"""Streaming queries: results must equal the batch operators (STR-01/02)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import fixtures as FX
from ..streaming import scoring as STR
from .catalog import register
from .common import round_doubles, rsql
from .oracle_fixtures import with_ctes
from .route_queries import _ROUTER

N_CHUNKS = 6


@register("str_01_streaming_route", with_ctes(["requests"], "SELECT request_id, domain, rationale, error FROM rt",
                                               _ROUTER))
def _str01(spark, sf):
    base = shared_dir(spark, "stream-route")
    req = FX.requests(spark, sf)
    req.repartition(4).write.mode("overwrite").parquet(f"{base}/source")
    STR.stream_route(spark, f"{base}/source", req.schema, f"{base}/sink", f"{base}/ckpt", max_files_per_trigger=2)
    return spark.read.parquet(f"{base}/sink")


@register("str_02_streaming_failure_rate", rsql(with_ctes(["timeline_b"], """
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bin, count(*) AS n, CAST(sum(fail) AS BIGINT) AS fails,
         CAST(sum(fail) AS DOUBLE) / count(*) AS fail_rate
  FROM timeline_b GROUP BY 1"""), ["fail_rate"]))
def _str02(spark, sf):
    base = shared_dir(spark, "stream-rate")
    t = FX.timeline(spark, sf, drop_days=True)
    lo_hi = t.agg(F.min("ts"), F.max("ts")).first()
    span = (lo_hi[1] - lo_hi[0]).total_seconds() or 1.0
    chunk = ((F.unix_timestamp("ts") - F.lit(lo_hi[0].timestamp())) / span * N_CHUNKS).cast("int")
    t = t.withColumn("_chunk", F.least(chunk, F.lit(N_CHUNKS - 1)))
    schema = t.drop("_chunk").schema
    # chunks arrive in time order, each as all the files its tasks write; the stream goes on from its
    # checkpoint after every arrival, so state carries across micro-batches
    for c in range(N_CHUNKS):
        t.filter(F.col("_chunk") == c).drop("_chunk").write.mode("append").parquet(f"{base}/source")
        STR.stream_failure_rate(spark, f"{base}/source", schema, f"{base}/sink", f"{base}/ckpt", max_files_per_trigger=None)
    out = STR.read_failure_rate(spark, f"{base}/sink")
    return round_doubles(out.withColumn("bin", F.date_format("bin", "yyyy-MM-dd")))

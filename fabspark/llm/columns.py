"""Column helpers for operators that stay inside Spark's own functions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK = 500


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` is a lambda over elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """Exclusive running sums of an array of longs. Appending copies the array, so
    it is built in chunks: the cost stays near linear for very long arrays."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def run(values: Column) -> Column:
        def chunk(acc: Column, c: Column) -> Column:
            inner = F.aggregate(
                F.slice(values, c * CHUNK + 1, F.lit(CHUNK)),
                F.struct(acc["at"].alias("at"), F.array().cast("array<bigint>").alias("out")),
                lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
            return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], i["out"]).alias("out")))
        chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
        return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(
            F.aggregate(chunks, start, chunk, lambda a: a["out"]))
    return let(lengths, run)

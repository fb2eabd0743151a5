"""Global order: rows before a row, and sums before it, without a one-task window."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage


def in_order(df: DataFrame, order: Sequence, sums: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Range-partition ``df`` by ``order``, sort each partition, and add
    ``_row`` (rows before this one) and ``_before_<c>`` for each ``c`` of ``sums``.

    Per-partition totals (one short row a partition, the only thing that reaches
    the driver) become the partitions' offsets. Returns the frame and the grand
    totals. The sorted rows are checkpointed once, so offsets and rows agree
    even if an executor is lost in between. Nulls in ``sums`` count as 0.
    """
    tagged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_part", F.spark_partition_id()))
    kept = cut_lineage(tagged)
    totals = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"),
                                       *[F.sum(c).alias(c) for c in sums]).collect()
    offsets: dict[int, list[int]] = {}
    running = [0] * (1 + len(sums))
    for row in sorted(totals, key=lambda r: r["_part"]):
        offsets[row["_part"]] = list(running)
        running = [running[0] + row["_n"], *(a + (row[c] or 0) for a, c in zip(running[1:], sums))]
    names = ["_row", *[f"_before_{c}" for c in sums]]
    schema = T.StructType([*kept.drop("_part").schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    fields = kept.drop("_part").columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                at = list(offsets[b.column("_part")[0].as_py()])
            cols = [b.column(c) for c in fields]
            cols.append(pa.array(at[0] + np.arange(b.num_rows, dtype=np.int64)))
            for i, c in enumerate(sums, 1):
                v = np.asarray(b.column(c).fill_null(0), dtype=np.int64)
                run = np.cumsum(v)
                cols.append(pa.array(at[i] + run - v))
                at[i] += int(run[-1])
            at[0] += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=[*fields, *names])

    return kept.mapInArrow(add, schema), dict(zip(["_row", *sums], running))

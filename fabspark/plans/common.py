"""Small helpers shared by the query modules."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column so results compare across engines whose
    float sums run in different orders."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def rsql(select: str, double_cols: list[str], digits: int = DIGITS) -> str:
    """Wrap an oracle query so the listed columns are rounded like ``round_doubles``."""
    if not double_cols:
        return select
    rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) AS "{c}"' for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({select}) _q"

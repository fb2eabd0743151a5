"""Label flattening for the nested label shapes of wafer tables.

Raw labels arrive as ``array<array<string>>`` (``[['Center']]``, ``[]``,
``[['']]``) or NULL. The first element of the flattened value, stripped, is
the label; empty or missing becomes an "unlabeled" token. The two reference
flavours differ only in that token. ``'none'`` is a real class.

Deviation (recorded): a scalar NULL maps to the unlabeled token, not to the
string ``'None'`` that one reference flavour produces by accident.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two unlabeled spellings.
YIELD_UNLABELED = "unlabeled"
CNN_UNLABELED = "Unlabeled"


def flatten_label(raw: Column | str, token: str = CNN_UNLABELED) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    first = F.get(F.flatten(raw), 0)
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), F.lit(token))


def flatten_string_label(raw: Column | str, token: str = CNN_UNLABELED) -> Column:
    """Same rule for labels that already arrive as plain strings."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit(token))

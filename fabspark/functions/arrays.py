"""Column expressions over flat row-major wafer maps and score vectors.

A wafer map is ``cells array<tinyint>`` plus ``rows``/``cols``; all functions
are higher-order SQL functions, so they stay in the JVM and need no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_where(arr: Column | str, pred) -> Column:
    return F.size(F.filter(_c(arr), pred))


def resize_nearest(cells: Column | str, rows: Column | str, cols: Column | str, size: int, via: Column | None = None) -> Column:
    """Nearest-neighbour resize to ``size x size``: source index
    ``min(floor(i * h / size), h - 1)`` per axis (flat row-major result). With ``via`` (a column; null: none) the map is
    first brought to ``via x via``: the indices of both steps are put together, no map in between is built."""
    cells, rows, cols = _c(cells), _c(rows), _c(cols)

    def source(i, length):
        if via is None:
            return F.least(F.floor(i * length / size), length - 1)
        grid = F.coalesce(via, F.lit(size)).cast("long")
        step = F.least(F.floor(i * grid / size), grid - 1)
        return F.least(F.floor(step * length / grid), length - 1)

    def pick(k):
        ri, ci = source(F.floor(k / size), rows), source(k % size, cols)
        return F.get(cells, (ri * cols + ci).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), pick)


def normalize_cells(cells: Column | str) -> Column:
    """Map {0,1,2} to [0,1] as float — the same expression for training and scoring."""
    return F.transform(_c(cells), lambda v: (v / 2.0).cast("float"))


# The eight symmetries of a square: (rotations k = 0..3) x (horizontal flip).
DIHEDRAL = [(k, f) for f in (False, True) for k in range(4)]


def dihedral(cells: Column | str, n: int, variant: int) -> Column:
    """Variant ``variant`` (0..7) of a square ``n x n`` map: ``variant % 4``
    counter-clockwise quarter turns, then a left-right flip when ``variant >= 4``.
    Dynamic ``variant`` columns are supported (index arithmetic per variant)."""
    cells = _c(cells)
    return _dihedral_expr(cells, n, F.lit(variant) if isinstance(variant, int) else variant)


def _dihedral_expr(cells: Column, n: int, v: Column) -> Column:
    last = n - 1

    def src(k):
        i = F.floor(k / n)
        j = k % n
        j2 = F.when(v >= 4, last - j).otherwise(j)      # flip applied to the output grid
        rot = v % 4
        # output (i, j2) of a CCW rotation by rot quarter turns reads source (si, sj)
        si = (F.when(rot == 0, i).when(rot == 1, j2).when(rot == 2, last - i).otherwise(last - j2))
        sj = (F.when(rot == 0, j2).when(rot == 1, last - i).when(rot == 2, last - j2).otherwise(i))
        return F.get(cells, (si * n + sj).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), src)


def softmax(z: Column | str) -> Column:
    z = _c(z)
    m = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def argmax_first(p: Column | str) -> Column:
    """0-based index of the first maximum."""
    p = _c(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def bround_all(p: Column | str, digits: int = 4) -> Column:
    return F.transform(_c(p), lambda v: F.bround(v, digits))

"""Exact k nearest neighbours over pivot cells.

A seeded sample of reference rows gives the pivots; every row belongs to the cell of its nearest pivot. A query
row is first compared with its home cell. Its k-th distance there (or, where the home cell is too small, the
distance that must hold k rows by the radii of the cells) bounds its true k-th distance, and only cells whose
lower bound does not exceed it are visited. Two lower bounds hold for a cell c with pivot p, home pivot h and
member distances in [near, far]: the ring, max(d(q,p) - far, near - d(q,p)), and the half-space between the
pivots, (d(q,p)^2 - d(q,h)^2) / (2 d(p,h)).

The result is the same as comparing all pairs; how many are spared depends on the data (clustered rows: most,
rows without structure in many dimensions: few).

* Neighbouring cells are packed and hot cells split by hash: at most about ``block_rows`` reference rows meet
  ``block_rows`` query rows in a task. A query row travels once to a pack, with the list of cells that it visits there.
* A task finds its candidates by a matrix product for each cell, with a margin for that product's rounding; these
  alone get their distance as a sum of squared differences, and ties and order go by it.
* What is read several times is checkpointed, so that neither plans nor cached frames pile up on the driver.
* Copies of one point need only their k + 1 smallest ids, since ties go by id; the rest leave the reference
  before anything is compared, so a point that holds a third of the rows is not compared with itself row by row.
* A group that fits into one block is one cell: it has no other cells to visit, and needs half the jobs.
* The driver holds the pivots and one row a cell: at most ``MAX_PIVOTS``.
* With ``group``, the neighbours of a row are those of its group: each group has pivots and cells of its own, and all
  groups go through the same jobs. Vectors may be of another length in another group.

Rows whose vector is null, or holds null, NaN or infinite entries, are no neighbours and have none. An empty
side gives no rows. Fewer than k possible neighbours: as many rows as there are. A query row that stands twice
counts once, a reference row as often as it stands; one query id on different vectors gets the k nearest of them
together. Vectors are of one length (an error names the lengths otherwise).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashing import h60
from ..session import cut_computed, in_parts
from .split import _per_class

BLOCK_ROWS = 16_384          # rows of one side in one comparison task
CELL_ROWS = 1024             # reference rows a cell aims at, where a group does not fit into one block
MAX_PIVOTS = 16_384
SLACK = 1e-9                 # rounding of a bound, relative to the distances it is made from
CHUNK_ENTRIES = 1 << 22      # entries of the difference block held at once


def _distances(a: np.ndarray, b: np.ndarray):
    """Squared distances of all rows of ``a`` to ``b``, some rows of ``a`` at a time."""
    step = max(1, CHUNK_ENTRIES // max(1, b.size))
    for s in range(0, len(a), step):
        yield slice(s, s + step), ((a[s:s + step, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as the rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _candidates(Q: np.ndarray, R: np.ndarray, qid: np.ndarray, rid: np.ndarray, bound: np.ndarray, k: int):
    """(i, j, squared distance) of all pairs that may be among the k nearest of their row of ``Q`` within ``bound``."""
    eps, entries = np.finfo(float).eps, max(1, CHUNK_ENTRIES // max(1, Q.shape[1]))
    step = max(1, CHUNK_ENTRIES // max(1, len(R)))
    with np.errstate(over="ignore", invalid="ignore"):
        qn, rn = (Q * Q).sum(axis=1), (R * R).sum(axis=1)
        margin = 8 * (Q.shape[1] + 4) * eps * (qn + rn.max(initial=0.0)) + np.finfo(float).tiny
        right = np.concatenate([R, rn[:, None], np.ones((len(R), 1))], axis=1).T
        for s in range(0, len(Q), step):
            at = slice(s, s + step)
            d = np.concatenate([-2 * Q[at], np.ones((len(Q[at]), 1)), qn[at, None]], axis=1) @ right
            limit = bound[at].copy()
            none = np.flatnonzero(~np.isfinite(limit))
            if len(none) and len(R) > k:
                own = qid[at][none, None] == rid[None, :]
                limit[none] = np.partition(np.where(own, np.inf, d[none]), k - 1, axis=1)[:, k - 1] + margin[at][none]
            i, j = np.nonzero(~(d > (limit + margin[at])[:, None]))               # overflowed products stay in
            for t in range(0, len(i), entries):
                a, b = i[t:t + entries] + s, j[t:t + entries]
                yield a, b, ((Q[a] - R[b]) ** 2).sum(axis=1)


def _nearest_block(k: int, exclude_self: bool, schema: pa.Schema):
    """The k nearest rows of ``r`` for every row of ``q``, among the cells that it visits, by (distance, id)."""
    def numbered(q: pa.Array, r: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes = pa.concat_arrays([q, r]).dictionary_encode().indices
        return codes[:len(q)].fill_null(-1).to_numpy(), codes[len(q):].fill_null(-2).to_numpy()

    def fn(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return schema.empty_table()
        r = r.sort_by("rid")
        Q, R, bound = _matrix(q["qx"]), _matrix(r["rx"]), q["bound"].to_numpy().copy()
        qid, rid = numbered(q["qid"].combine_chunks(), r["rid"].combine_chunks())
        if not exclude_self:
            rid = np.full(len(rid), -2)
        lists, cell = q["cells"].combine_chunks(), r["cell"].to_numpy()
        owner, visited = np.repeat(np.arange(len(Q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for c in np.unique(visited):
            rows, refs = owner[visited == c], np.flatnonzero(cell == c)
            found = [best]
            for i, j, d in _candidates(Q[rows], R[refs], qid[rows], rid[refs], bound[rows], k) if len(refs) else ():
                i, j = rows[i], refs[j]
                keep = np.isfinite(d) & (d <= bound[i]) & (qid[i] != rid[j])
                found.append((i[keep], j[keep], d[keep]))
            i, j, d = (np.concatenate(part) for part in zip(*found))
            order = np.lexsort((j, d, i))                          # rows of r stand by id
            rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
            best = tuple(part[order[rank < k]] for part in (i, j, d))
            kth = order[rank == k - 1]
            bound[i[kth]] = d[kth]
        i, j, d = best
        return pa.Table.from_arrays([q["qid"].take(pa.array(i)), r["rid"].take(pa.array(j)), pa.array(d), r["rlabel"].take(pa.array(j)),
                                     q["grp"].take(pa.array(i))], schema=schema)
    return fn


def _usable(x: str):
    c = F.col(x)
    return c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def _pivots(ref: DataFrame, sizes: dict[int, int], cell_rows: int | None, block_rows: int) -> dict[int, tuple[int, np.ndarray]]:
    """By group, its first cell and the distinct vectors of a seeded sample of about ``n / cell_rows`` of its reference
    rows; at most ``MAX_PIVOTS`` in all, or one a group. Any pivots give right results. The hash cut keeps what the
    tasks send near the number wanted."""
    aim = {g: cell_rows or (n if n <= block_rows else CELL_ROWS) for g, n in sizes.items()}
    want = {g: max(1, min(MAX_PIVOTS // len(sizes), math.ceil(n / aim[g]))) for g, n in sizes.items()}
    cut = {g: 2 ** 60 - 1 if 8 * want[g] >= n else int(2 ** 60 * (2 * want[g] + 20) / n) for g, n in sizes.items()}
    keyed = ref.withColumn("_key", h60(F.concat(F.lit("pivot:"), F.col("rid").cast("string"))))
    first = Window.partitionBy("grp").orderBy("_key", "rid")
    kept = (keyed.filter(F.col("_key") <= _per_class("grp", cut)).withColumn("_rank", F.row_number().over(first))
            .filter(F.col("_rank") <= _per_class("grp", want)))
    rows: dict[int, list] = {}
    for r in kept.select("grp", "rx").collect():
        rows.setdefault(r["grp"], []).append(r["rx"])
    out, at = {}, 0
    for g in sorted(sizes):
        if g not in rows:                            # the cut kept no row: any one will do
            rows[g] = [r["rx"] for r in ref.filter(F.col("grp") == g).select("rx").limit(1).collect()]
        vectors = np.unique(np.array(rows[g], dtype=float), axis=0)
        out[g], at = (at, vectors), at + len(vectors)
    return out


def _in_cells(df: DataFrame, x: str, pivots: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """``df`` with ``cell`` (nearest pivot of the group, the first of several; -1 where it has none) and ``to_pivot``
    (distance to it)."""
    def fn(batches):
        for b in batches:
            cell, dist = np.full(len(b), -1, dtype="int32"), np.zeros(len(b))
            for g, at in b.groupby("grp").indices.items():
                if g in pivots:
                    start, P = pivots[g]
                    for rows, d in _distances(_stack(b[x].iloc[at]), P):
                        cell[at[rows]] = d.argmin(axis=1) + start
                        dist[at[rows]] = np.sqrt(d.min(axis=1))
            yield b.assign(cell=cell, to_pivot=dist)
    schema = T.StructType(df.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("to_pivot", T.DoubleType())])
    return df.mapInPandas(fn, schema)


def _visits(home: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], cells: pd.DataFrame, need: int, k: int) -> DataFrame:
    """``(grp, qid, qx, bound, pack, cells)``: the cells besides its home that can hold one of the ``k`` nearest rows of a
    query row, a row for each pack of them, and the squared distance that none of these exceeds. ``home`` has
    (grp, qid, qx, cell, found, kth): rows found in the home cell and the k-th squared distance there."""
    of_group = {}
    for g, own in cells.groupby("grp"):
        start, vectors = pivots[g]
        P = vectors[own["cell"].to_numpy() - start]
        apart = np.sqrt(((vectors[:, None, :] - P[None, :, :]) ** 2).sum(axis=2)) if len(vectors) <= 512 else None
        of_group[g] = (start, vectors, P, apart, *(own[c].to_numpy() for c in ("cell", "pack", "near", "far", "n")))

    def fn(batches):
        for whole in batches:
            for g, at in whole.groupby("grp").indices.items():
                if g not in of_group:
                    continue
                b, (start, pivots, P, apart, index, pack, near, far, rows_in) = whole.iloc[at], of_group[g]
                of, to, lists = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype="int32")], []
                Q, homes = _stack(b["qx"]), b["cell"].to_numpy() - start
                kth = np.where(b["found"].to_numpy() >= k, np.sqrt(b["kth"].to_numpy()), np.inf)
                for rows, d2 in _distances(Q, P):
                    d, h = np.sqrt(d2), homes[rows]
                    reach = d + far[None, :]                       # every row of the cell lies within this distance
                    order = np.argsort(reach, axis=1, kind="stable")
                    enough = np.cumsum(rows_in[order], axis=1) >= need
                    first = enough.argmax(axis=1)
                    bound = np.where(enough.any(axis=1), np.take_along_axis(reach, order, 1)[np.arange(len(d)), first], np.inf)
                    bound = np.minimum(bound, kth[rows])[:, None]
                    to_home = np.sqrt(((Q[rows] - pivots[h]) ** 2).sum(axis=1))[:, None]
                    gap = apart[h] if apart is not None else np.sqrt(
                        np.stack([((P - pivots[c]) ** 2).sum(axis=1) for c in h]))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        half = np.where(gap > 0, (d2 - to_home ** 2) / (2 * gap), 0.0)
                    low = np.maximum(np.maximum(d - far[None, :], near[None, :] - d), half)
                    scale = d + far[None, :] + np.where(gap > 0, (d2 + to_home ** 2) / np.maximum(gap, 1e-300), 0.0)
                    i, j = np.nonzero((low <= bound + SLACK * scale) & (index[None, :] != h[:, None] + start))
                    if len(i):
                        first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (pack[j[1:]] != pack[j[:-1]])])   # packs follow the cells
                        of.append(i[first] + rows.start)
                        to.append(pack[j[first]])
                        lists += np.split(index[j].astype("int32"), first[1:])
                of, bound = np.concatenate(of), np.where(b["found"] >= k, b["kth"], np.inf)
                yield pd.DataFrame({"grp": b["grp"].to_numpy()[of], "qid": b["qid"].to_numpy()[of], "qx": b["qx"].to_numpy()[of],
                                    "bound": bound[of].astype(float), "pack": np.concatenate(to).astype("int32"),
                                    "cells": pd.Series(lists, dtype=object)})
    fields = {f.name: f for f in home.schema.fields}
    return home.mapInPandas(fn, T.StructType([fields["grp"], fields["qid"], fields["qx"], T.StructField("bound", T.DoubleType()),
                                              T.StructField("pack", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _packed(cells: pd.DataFrame, block_rows: int) -> pd.DataFrame:
    """``cells`` with ``pack`` (cells of a group that follow each other, up to ``block_rows`` rows, or one larger cell)
    and its ``parts``."""
    pack, held, at, last = 0, 0, [], None
    for n, g in zip(cells["n"], cells["grp"] if "grp" in cells else [0] * len(cells)):
        if held and (held + n > block_rows or g != last):
            pack, held = pack + 1, 0
        held, last = held + n, g
        at.append(pack)
    out = cells.assign(pack=np.array(at, dtype="int32"))
    return out.assign(parts=np.ceil(out.groupby("pack")["n"].transform("sum") / block_rows).astype("int32"))


def _compare(q: DataFrame, ref: DataFrame, cells: pd.DataFrame, visits: dict, k: int, exclude_self: bool,
             block_rows: int, schema: T.StructType) -> DataFrame:
    """Candidates of the query rows (grp, qid, qx, bound, pack, cells): both sides of a pack in blocks. ``visits``: rows by pack."""
    layout = [(int(c), int(p), int(n), math.ceil(visits[p] / block_rows))
              for c, p, n in zip(cells["cell"], cells["pack"], cells["parts"]) if visits.get(p)]
    spark = q.sparkSession
    lay = spark.createDataFrame(layout, "cell int, pack int, parts int, pieces int")     # one row a cell
    packs = spark.createDataFrame(sorted({row[1:] for row in layout}), "pack int, parts int, pieces int")
    a = (q.join(F.broadcast(packs), "pack")
         .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
         .withColumn("piece", F.pmod(h60(F.concat(F.lit("q:"), F.col("qid").cast("string"))), F.col("pieces")).cast("int"))
         .select("grp", "qid", "qx", "bound", "cells", "pack", "part", "piece"))
    b = (ref.join(F.broadcast(lay), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
         .withColumn("part", F.pmod(h60(F.concat(F.lit("r:"), F.col("rid").cast("string"))), F.col("parts")).cast("int"))
         .select("rid", "rx", "rlabel", "cell", "pack", "part", "piece"))
    key = ["pack", "part", "piece"]
    blocks = sum(parts * pieces for _, parts, pieces in {row[1:] for row in layout})
    tasks = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    a, b = a.repartition(tasks, *key), b.repartition(tasks, *key)
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_nearest_block(k, exclude_self, to_arrow_schema(schema)), schema)


def knn(query: DataFrame, ref: DataFrame, k: int, id_col: str = "unit_id", x: str = "x", y: str = "y",
        exclude_self: bool = True, block_rows: int = BLOCK_ROWS, cell_rows: int | None = None,
        stats: dict | None = None, group: str | None = None) -> DataFrame:
    """``(qid, slot, nid, dist, nlabel)``: the ``k`` nearest reference rows of every query row by squared Euclidean
    distance (ties by neighbour id), slot 0..k-1. ``stats`` receives the number of cells, of reference points and
    of compared pairs. With ``group`` (a column of few integers) neighbours are those of the same group, and the
    result begins with that column."""
    need = k + 1 if exclude_self else k
    grp = (F.lit(0) if group is None else F.col(group).cast("int")).alias("grp")
    out = ([] if group is None else [F.col("grp").alias(group)]) + ["qid", "slot", "nid", "dist", "nlabel"]
    q = query.filter(_usable(x)).select(grp, F.col(id_col).alias("qid"), F.col(x).cast("array<double>").alias("qx")).distinct()
    r = ref.filter(_usable(x)).select(grp, F.col(id_col).alias("rid"), F.col(x).cast("array<double>").alias("rx"),
                                      F.col(y).cast("long").alias("rlabel"))
    copies = Window.partitionBy("grp", "rx").orderBy("rid")
    r = r.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= need).drop("_copy")
    n_ref = ref.count()
    r = cut_computed(r, n_ref)
    id_type = query.schema[id_col].dataType
    schema = T.StructType([T.StructField("qid", id_type), T.StructField("nid", id_type),
                           T.StructField("dist", T.DoubleType()), T.StructField("nlabel", T.LongType()),
                           T.StructField("grp", T.IntegerType())])
    widths = r.groupBy("grp").agg(F.count("*").alias("n"), F.min(F.size("rx")).alias("short"), F.max(F.size("rx")).alias("long")).collect()
    sizes = {w["grp"]: w["n"] for w in widths}                           # a row a group
    n = sum(sizes.values())
    stats = {} if stats is None else stats
    if n == 0:
        stats.update(cells=0, points=0, pairs=0)
        return q.sparkSession.createDataFrame([], schema).withColumn("slot", F.lit(0)).select(*out)
    for w in widths:
        if w["short"] != w["long"]:
            raise ValueError(f"vectors of different lengths: {w['short']} to {w['long']}")
    pivots = _pivots(r, sizes, cell_rows, block_rows)
    n_query = n_ref if query is ref else query.count()
    r = cut_computed(_in_cells(r, "rx", pivots))
    q = cut_computed(_in_cells(in_parts(q, n_query), "qx", pivots))
    # at most MAX_PIVOTS rows each, and fewer packs
    cells = r.groupBy("cell").agg(F.count("*").alias("n"), F.min("to_pivot").alias("near"),
                                  F.max("to_pivot").alias("far")).orderBy("cell").toPandas()
    order = sorted(pivots)
    cells["grp"] = [order[i] for i in np.searchsorted([pivots[g][0] for g in order], cells["cell"], side="right") - 1]
    cells = _packed(cells, block_rows)
    size, pack_of = dict(zip(cells["cell"], cells["n"])), dict(zip(cells["cell"], cells["pack"]))
    at_home = {row["cell"]: row["count"] for row in q.groupBy("cell").count().collect()}
    stats.update(cells=len(cells), points=n, pairs=int(sum(c * size.get(h, 0) for h, c in at_home.items())))
    # the k nearest of each block: at most k x blocks of the cells a query row is compared with
    by_query = Window.partitionBy("grp", "qid").orderBy("dist", "nid")
    packs = F.broadcast(q.sparkSession.createDataFrame([(int(c), int(p)) for c, p in pack_of.items()], "cell int, pack int"))
    own: dict = {}
    for c, n_rows in at_home.items():
        if c in pack_of:
            own[pack_of[c]] = own.get(pack_of[c], 0) + n_rows
    home = q.join(packs, "cell").select("grp", "qid", "qx", F.lit(float("inf")).alias("bound"), "pack", F.array("cell").alias("cells"))
    first = _compare(home, r, cells, own, k, exclude_self, block_rows, schema)
    top = first.withColumn("_rank", F.row_number().over(by_query)).filter(F.col("_rank") <= k)
    if len(cells) > cells["grp"].nunique():
        top = cut_computed(top.drop("_rank"), n_query * k)
        kth = top.groupBy("grp", "qid").agg(F.count("*").alias("found"), F.max("dist").alias("kth"))
        home = (q.join(kth, ["grp", "qid"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
                .select("grp", "qid", "qx", "cell", "found", F.coalesce("kth", F.lit(float("inf"))).alias("kth")))
        away = cut_computed(_visits(in_parts(home, n_query), pivots, cells, need, k))
        visits = {row["pack"]: row["count"] for row in away.groupBy("pack").count().collect()}
        met = away.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
        stats["pairs"] += int(sum(row["count"] * size[row["cell"]] for row in met))
        more = _compare(away, r, cells, visits, k, exclude_self, block_rows, schema)
        top = (top.unionByName(more).withColumn("_rank", F.row_number().over(by_query)).filter(F.col("_rank") <= k))
    return top.withColumn("slot", (F.col("_rank") - 1).cast("int")).select(*out)

"""k-nearest-neighbour based resampling: SMOTE, borderline SMOTE, ADASYN,
SMOTE + edited nearest neighbours, SMOTE + Tomek links.

The neighbours come from ``knn`` (exact, over pivot cells).

Synthetic rows use hash-seeded draws (``spark.range`` + md5) and equi-joins:
sample = x_seed + u * (x_neighbour - x_seed).

With ``group`` (a column of few integers, such as the fold left out) SMOTE and its edited forms resample every group by
itself, all groups in the same jobs, with the rows that each group alone would give.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import h60
from ..session import cut_computed
from .knn import knn
from .split import SEED, by_group, class_counts, grouped_counts, seeded_rank
from .resample import minority_majority

QUOTA_PIECE = 1000            # draws exploded from one row at once
U_BITS = 2 ** 20


def _draw(j, seed: int, tag: str):
    return h60(F.concat(j.cast("string"), F.lit(f":{tag}:{seed}")))


def _synthesise(seeds: DataFrame, minority: DataFrame, nn: DataFrame, n_draw: dict, k: int, id_col: str,
                x: str, y, seed: int, label: dict, group: str | None = None) -> DataFrame:
    """Draw ``n_draw`` (seed, neighbour slot, step) triples a group; ``seeds`` carry a
    1-based ``srank``; ``nn`` = knn(seeds, minority)."""
    spark, by = seeds.sparkSession, _keys(group)
    n_seeds = {r[group] if group else None: r["n"] for r in seeds.groupBy(*by).agg(F.count("*").alias("n")).collect()}   # a row a group
    n_draw = {g: n for g, n in n_draw.items() if n > 0 and n_seeds.get(g)}
    if not n_draw:
        return None
    j = F.col("id")
    draws = spark.range(max(n_draw.values()))
    if group:
        draws = draws.withColumn(group, F.explode(F.array(*[F.lit(g) for g in n_draw]))).filter(j < by_group(group, n_draw))
    draws = draws.select(
        *by, j.alias("draw"), (_draw(j, seed, "s") % by_group(group, {g: n_seeds[g] for g in n_draw}) + 1).alias("srank"),
        (_draw(j, seed, "n") % k).cast("int").alias("slot"),
        ((_draw(j, seed, "u") % U_BITS).cast("double") / U_BITS).alias("u"))
    return _materialise(draws, seeds, minority, nn, id_col, x, y, by_group(group, label), group)


def _keys(group: str | None) -> list[str]:
    return [group] if group else []


def _materialise(draws, seeds, minority, nn, id_col, x, y, label, group=None):
    by = _keys(group)
    s = seeds.select(*by, F.col("srank"), F.col(id_col).alias("sid"), F.col(x).alias("sx"))
    m = minority.select(*by, F.col(id_col).alias("nid"), F.col(x).alias("nx"))
    nnl = nn.select(*by, F.col("qid").alias("sid"), "slot", "nid")
    g = draws.join(s, [*by, "srank"]).join(nnl, [*by, "sid", "slot"]).join(m, [*by, "nid"])
    new_x = F.zip_with("sx", "nx", lambda a, b: a + F.col("u") * (b - a))
    own = -(F.col("draw") + 1)
    if isinstance(seeds.schema[id_col].dataType, T.StringType):
        own = F.concat(F.lit("synthetic"), own.cast("string"))
    return g.select(*by, own.alias(id_col), label.alias(y), new_x.alias(x),
                    F.lit(True).alias("synthetic"))


def _check_k(k: int, n_min: int) -> None:
    if k >= n_min:
        raise ValueError(f"k = {k} neighbours need more than {k} minority rows; there are {n_min}")


def _base(df, id_col, x, y, group=None):
    return df.select(*_keys(group), id_col, y, x, F.lit(False).alias("synthetic"))


def smote(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", k: int = 5,
          seed: int = SEED, group: str | None = None, **_) -> DataFrame:
    """RES-05: n_maj - n_min synthetic minority rows between k-NN pairs."""
    label, n_draw = {}, {}
    for g, counts in grouped_counts(df, y, group).items():
        lo, hi = minority_majority(counts)
        _check_k(k, counts[lo])
        label[g], n_draw[g] = lo, counts[hi] - counts[lo]
    minority = df.filter(F.col(y) == by_group(group, label))
    seeds = seeded_rank(minority, id_col, _keys(group), seed).withColumnRenamed("rank", "srank")
    nn = knn(minority, minority, k, id_col, x, y, group=group)
    syn = _synthesise(seeds, minority, nn, n_draw, k, id_col, x, y, seed, label, group)
    base = _base(df, id_col, x, y, group)
    return base if syn is None else base.unionByName(syn)


def danger_seeds(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", m: int = 10) -> DataFrame:
    """Minority rows with m/2 <= majority neighbours < m among their m NN in the full set."""
    counts = class_counts(df, y)
    lo, _ = minority_majority(counts)
    minority = df.filter(F.col(y) == F.lit(lo))
    nn = knn(minority, df, m, id_col, x, y)
    n_maj = nn.groupBy("qid").agg(F.count_if(F.col("nlabel") != F.lit(lo)).alias("n_maj"))
    danger = n_maj.filter((F.col("n_maj") >= m / 2.0) & (F.col("n_maj") < m)).select(F.col("qid").alias(id_col))
    return minority.join(danger, id_col, "left_semi")


def borderline_smote(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", k: int = 5,
                     m: int = 10, seed: int = SEED, **_) -> DataFrame:
    """RES-06: SMOTE seeded only from 'danger' minority rows; neighbours
    come from the whole minority class."""
    counts = class_counts(df, y)
    lo, hi = minority_majority(counts)
    _check_k(k, counts[lo])
    minority = df.filter(F.col(y) == F.lit(lo))
    seeds = seeded_rank(danger_seeds(df, y, id_col, x, m), id_col, (), seed).withColumnRenamed("rank", "srank")
    nn = knn(seeds, minority, k, id_col, x, y)
    syn = _synthesise(seeds, minority, nn, {None: counts[hi] - counts[lo]}, k, id_col, x, y, seed, {None: lo})
    base = _base(df, id_col, x, y)
    return base if syn is None else base.unionByName(syn)


def adasyn(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", k: int = 5,
           seed: int = SEED, **_) -> DataFrame:
    """RES-07: per minority row, rint(ratio_i / sum(ratio) * (n_maj - n_min))
    synthetic rows, ratio_i = majority share among its k NN in the full set."""
    counts = class_counts(df, y)
    lo, hi = minority_majority(counts)
    _check_k(k, counts[lo])
    minority = df.filter(F.col(y) == F.lit(lo))
    nn_all = knn(minority, df, k, id_col, x, y)
    ratio = nn_all.groupBy("qid").agg((F.count_if(F.col("nlabel") != F.lit(lo)) / k).alias("ratio"))
    total = ratio.agg(F.sum("ratio")).scalar()
    n_gen = counts[hi] - counts[lo]
    per = ratio.select(F.col("qid").alias(id_col),
                       F.rint(F.col("ratio") / total * n_gen).cast("long").alias("n_i"))
    per = per.filter(F.col("n_i") > 0)
    nn = knn(minority, minority, k, id_col, x, y)
    # draws: row i gets n_i draws; a large quota is dealt out in pieces before it is exploded
    seeds = seeded_rank(minority, id_col, (), seed).withColumnRenamed("rank", "srank")
    most = per.agg(F.max("n_i")).first()[0] or 1
    d = (per.join(seeds.select(id_col, "srank"), id_col)
         .withColumn("t0", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_i"), F.lit(QUOTA_PIECE).cast("long"))))
         .repartition("srank", "t0")
         .withColumn("t", F.explode(F.sequence(F.col("t0"), F.least(F.col("t0") + QUOTA_PIECE - 1, F.col("n_i"))))))
    j = F.col("srank") * F.lit(most + 1) + F.col("t")          # one id a draw: t never exceeds `most`
    draws = d.select(j.alias("draw"), "srank", (_draw(j, seed, "n") % k).cast("int").alias("slot"),
                     ((_draw(j, seed, "u") % U_BITS).cast("double") / U_BITS).alias("u"))
    syn = _materialise(draws, seeds, minority, nn, id_col, x, y, F.lit(lo))
    return _base(df, id_col, x, y).unionByName(syn)


def _smote_held(df, y, id_col, x, seed, group):
    """SMOTE's rows, checkpointed: the editing step reads them several times."""
    rows = sum(len(counts) * max(counts.values()) for counts in grouped_counts(df, y, group).values())
    return cut_computed(smote(df, y, id_col, x, seed=seed, group=group), rows)


def enn_filter(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", k: int = 3, group: str | None = None) -> DataFrame:
    """Edited nearest neighbours ('all' classes): drop rows whose k NN do not all share their class."""
    by = _keys(group)
    nn = knn(df, df, k, id_col, x, y, group=group)
    lab = df.select(*by, F.col(id_col).alias("qid"), F.col(y).cast("long").alias("qlabel"))
    bad = (nn.join(lab, [*by, "qid"]).filter(F.col("nlabel") != F.col("qlabel"))
           .select(*by, F.col("qid").alias(id_col)).distinct())
    return df.join(bad, [*by, id_col], "left_anti")


def tomek_filter(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", group: str | None = None) -> DataFrame:
    """Remove both ends of Tomek links: mutual 1-NN pairs of different classes."""
    by = _keys(group)
    nn = knn(df, df, 1, id_col, x, y, group=group).select(*by, "qid", "nid", "nlabel")
    back = nn.select(*by, F.col("qid").alias("nid"), F.col("nid").alias("qid"))
    lab = df.select(*by, F.col(id_col).alias("qid"), F.col(y).cast("long").alias("qlabel"))
    links = (nn.join(back, [*by, "qid", "nid"]).join(lab, [*by, "qid"])
             .filter(F.col("nlabel") != F.col("qlabel")).select(*by, F.col("qid").alias(id_col)))
    return df.join(links, [*by, id_col], "left_anti")


def smote_enn(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", seed: int = SEED, group: str | None = None) -> DataFrame:
    """RES-08 (a non-default sampling ratio is not passed on, as in the reference)."""
    return enn_filter(_smote_held(df, y, id_col, x, seed, group), y, id_col, x, group=group)


def smote_tomek(df: DataFrame, y: str = "y", id_col: str = "unit_id", x: str = "x", seed: int = SEED, group: str | None = None) -> DataFrame:
    """RES-09."""
    return tomek_filter(_smote_held(df, y, id_col, x, seed, group), y, id_col, x, group=group)

"""Leak-free preparation of the sensor matrix: fit on training rows, apply anywhere.

Fixed step order (as the reference's pipeline):

1. missing indicators for columns with ``indicator_threshold < rate < 1``
   (appended as ``<name>__missing``; originals pass through)
2. drop columns with missing rate > ``missing_threshold`` (keep all if none survive)
3. median imputation (exact medians, ``quantiles``)
4. drop columns with population variance <= ``var_threshold``
5. standard scaling with population std (zero std -> 1)
6. optional SelectKBest by ANOVA F or neighbour-based mutual information

``fit`` runs a few grouped aggregations over the long form of the TRAINING
rows and keeps only per-feature state (index arrays and statistics — size =
number of features). ``transform`` is one projection of array expressions:
no join, no shuffle, safe on any number of rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_median

# Preparation defaults.
INDICATOR_THRESHOLD = 0.05
MISSING_THRESHOLD = 0.5
VAR_THRESHOLD = 1e-8


def _lit_array(values, typ: str):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{typ}>")


@dataclass
class PrepModel:
    names_in: list[str]
    indicator_idx: list[int]
    keep_missing: list[int]          # indices into [x, indicators]
    medians: list[float]             # per keep_missing column
    keep_var: list[int]              # indices into the imputed array
    means: list[float]               # per keep_var column
    stds: list[float]
    selected: list[int] | None = None    # indices into the scaled array
    scores: list[float] | None = field(default=None)

    # ------------------------------------------------------------ naming
    @property
    def names_with_indicators(self) -> list[str]:
        return self.names_in + [f"{self.names_in[i]}__missing" for i in self.indicator_idx]

    @property
    def feature_names(self) -> list[str]:
        """FIT-07: names reaching the estimator."""
        n1 = self.names_with_indicators
        n2 = [n1[j] for j in self.keep_missing]
        n3 = [n2[j] for j in self.keep_var]
        return [n3[j] for j in self.selected] if self.selected is not None else n3

    # ----------------------------------------------------------- applying
    def with_indicators(self, x):
        ind = F.transform(_lit_array(self.indicator_idx, "int"),
                          lambda i: F.when(F.get(x, i).isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
        return F.concat(x, ind)

    def _gather(self, x, picks, finish=lambda v, pos: v):
        """One pass over the picked columns, each straight from its source slot: a step built on the array
        of the step before would compute that array anew for every element."""
        width = len(self.names_in)
        source = [self.keep_missing[p] for p in picks]
        flags = _lit_array([j >= width for j in source], "boolean")
        slots = _lit_array([self.indicator_idx[j - width] if j >= width else j for j in source], "int")
        medians = _lit_array([self.medians[p] for p in picks], "double")

        def value(slot, pos):
            v = F.get(x, slot)
            missing = F.when(v.isNull(), F.lit(1.0)).otherwise(F.lit(0.0))
            return finish(F.when(F.get(flags, pos), missing).otherwise(F.coalesce(v, F.get(medians, pos))), pos)
        return F.transform(slots, value)

    def imputed(self, x):
        return self._gather(x, range(len(self.keep_missing)))

    def scaled(self, x):
        chosen = range(len(self.keep_var)) if self.selected is None else self.selected
        mu, sd = (_lit_array([v[q] for q in chosen], "double") for v in (self.means, self.stds))
        return self._gather(x, [self.keep_var[q] for q in chosen], lambda v, pos: (v - F.get(mu, pos)) / F.get(sd, pos))

    def transform(self, df: DataFrame, x: str = "x", out: str = "features") -> DataFrame:
        return df.withColumn(out, self.scaled(F.col(x)))


def _long(df: DataFrame, xcol) -> DataFrame:
    return df.select(F.posexplode(xcol).alias("i", "v"))


def _collect_map(df: DataFrame, key: str, val: str) -> dict:
    # one row per feature: bounded by the feature count, not by the data
    return {r[key]: r[val] for r in df.select(key, val).collect()}


def fit(train: DataFrame, x: str = "x", y: str = "y", names: list[str] | None = None,
        indicator_threshold: float = INDICATOR_THRESHOLD, missing_threshold: float = MISSING_THRESHOLD,
        var_threshold: float = VAR_THRESHOLD, k_features: int | None = None, score: str = "f") -> PrepModel:
    """FIT-08: fit every step on ``train`` only."""
    width = train.select(F.max(F.size(x))).first()[0] or 0
    names = names or [f"feature_{i:03d}" for i in range(width)]
    long = _long(train, F.col(x)).withColumn("fold", F.lit(1))
    med = {(0, r["i"]): r["median"] for r in exact_median(long, ["i"], "v").collect()}
    m = _outside_fold(0, _parts(long, "fold"), med, names, "fold", indicator_threshold, missing_threshold, var_threshold)
    keep2 = m.keep_var
    if k_features is not None and k_features < len(keep2):                                     # FIT-06
        if score == "f":
            sc = anova_f(train.select(F.col(y), m.scaled(F.col(x)).alias("_f")), "_f", y)
        elif score == "mutual_info":
            sc = mutual_info_scores(m, train, x, y)
        else:
            raise ValueError(f"score must be f or mutual_info, not {score!r}")
        s = _collect_map(sc, "i", "score")
        order = sorted(range(len(keep2)), key=lambda j: (-(s.get(j) if s.get(j) is not None else float("-inf")), -j))
        m.selected = sorted(order[:k_features])
        m.scores = [s.get(j) for j in range(len(keep2))]
    return m


def mutual_info_scores(m: PrepModel, train: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``(i, score)``: neighbour-based mutual information of each column that reaches the selection. It does not
    depend on the scale, so the imputed values are taken as they are."""
    from .mutual_info import neighbour_mutual_information
    kept = train.select(F.col(y), m._gather(F.col(x), m.keep_var).alias("_f"))
    return neighbour_mutual_information(kept, "_f", y).withColumnRenamed("mutual_info", "score")


def fit_folds(folded: DataFrame, k: int, fold: str = "fold", x: str = "x", names: list[str] | None = None,
              indicator_threshold: float = INDICATOR_THRESHOLD, missing_threshold: float = MISSING_THRESHOLD,
              var_threshold: float = VAR_THRESHOLD) -> list[PrepModel]:
    """``fit`` on the rows outside each of ``k`` folds, all at once: one aggregation by (fold, feature), from which
    each fold's own part is left out, and one quantile run for the medians of all folds."""
    long = folded.select(fold, F.posexplode(x).alias("i", "v"))
    rows = _parts(long, fold)
    width = max((r["i"] for r in rows), default=-1) + 1
    names = names or [f"feature_{i:03d}" for i in range(width)]
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
    outside = folded.select(F.explode(others).alias("_out"), F.col(x)).select("_out", F.posexplode(x).alias("i", "v"))
    med = {(r["_out"], r["i"]): r["median"] for r in exact_median(outside, ["_out", "i"], "v").collect()}
    return [_outside_fold(f, rows, med, names, fold, indicator_threshold, missing_threshold, var_threshold) for f in range(k)]


def _parts(long: DataFrame, fold: str) -> list:
    """Count, missing values, mean and variance by (fold, feature): bounded by folds x features."""
    return long.groupBy(fold, "i").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("miss"),
                                       F.avg("v").alias("mean"), F.var_pop("v").alias("var")).collect()


def _outside_fold(f: int, rows, med: dict, names: list[str], fold: str, indicator_threshold: float, missing_threshold: float,
                  var_threshold: float) -> PrepModel:
    """FIT-01 to FIT-05 from the parts (count, missing, mean, variance) of all folds but ``f`` and the medians by
    (fold, feature): imputation adds a block of ``miss`` equal values, which pooling needs no pass over the rows for."""
    parts: dict[int, list] = {}
    for r in rows:
        if r[fold] != f:
            parts.setdefault(r["i"], []).append(r)
    width = len(names)
    n = {i: sum(r["n"] for r in p) for i, p in parts.items()}
    miss = {i: sum(r["miss"] for r in p) for i, p in parts.items()}
    rate = [miss[i] / n[i] if n.get(i) else 0.0 for i in range(width)]
    ind = [i for i in range(width) if indicator_threshold < rate[i] < 1.0]
    rates = rate + [0.0] * len(ind)
    keep = [j for j, r in enumerate(rates) if r <= missing_threshold] or list(range(len(rates)))

    def state(j: int) -> tuple[float, float, float] | None:
        """Median, mean and population variance of one column after imputation."""
        if j >= width:                                       # an indicator: 1 where the value is missing
            share = rate[ind[j - width]]
            return (1.0 if share > 0.5 else 0.5 if share == 0.5 else 0.0), share, share * (1 - share)
        median = med.get((f, j))
        if median is None:
            return None
        blocks = [(r["n"] - r["miss"], r["mean"], r["var"]) for r in parts[j] if r["n"] > r["miss"]] + [(miss[j], median, 0.0)]
        mean = sum(c * m for c, m, _ in blocks) / n[j]
        return median, mean, sum(c * (v + (m - mean) ** 2) for c, m, v in blocks) / n[j]
    found = [(j, s) for j in keep if (s := state(j)) is not None]     # all-missing columns are dropped
    m = PrepModel(names, ind, [j for j, _ in found], [s[0] for _, s in found], [], [], [])
    m.keep_var = [p for p, (_, s) in enumerate(found) if s[2] > var_threshold]
    m.means = [found[p][1][1] for p in m.keep_var]
    m.stds = [found[p][1][2] ** 0.5 or 1.0 for p in m.keep_var]
    return m


def anova_f(df: DataFrame, xcol: str, y: str) -> DataFrame:
    """``(i, score)``: one-way ANOVA F statistic of each feature across classes
    (between-class mean square / within-class mean square); NULL when undefined."""
    long = df.select(F.col(y), F.posexplode(xcol).alias("i", "v"))
    per = long.groupBy("i", y).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    tot = per.groupBy("i").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"),
                               F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between_raw"))
    ssb = F.col("between_raw") - F.col("S") * F.col("S") / F.col("N")
    ssw = F.col("SS") - F.col("between_raw")
    f = F.try_divide(ssb / (F.col("k") - 1), F.nullif(ssw / (F.col("N") - F.col("k")), F.lit(0.0)))
    return tot.select("i", f.alias("score"))

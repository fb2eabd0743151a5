"""Sensor pass/fail training, cross-validation, selection and scoring, plus the wafer-pattern classifier.

Preparation (``prep``) and resampling (``resample``/``smote``) are fitted inside each training fold only. What the
folds need is made once (``Folds``) and shared by every configuration and every draw of parameters: k preparations
come from one aggregation and one quantile run, each resampled fold is held once a strategy. All tree models of
a comparison or search are grown in one job keyed by model (``trees``); metrics of all (model, fold) pairs come from
one grouped curve. Estimators:

* logreg      -> Spark ML LogisticRegression, L2, regParam = 1 / (C * sum(w)), no standardisation
* balanced_rf -> ``trees``: a balanced bootstrap a tree, Gini splits
* hist_gb     -> ``trees``: best-first growth to a leaf limit, l2, at least 20 rows a leaf
* xgboost     -> ``trees``: growth to a depth, l2, minimum hessian of a child, samples of rows and columns, positives
                 weighted by the class ratio

Trees are grown from all rows of their frame; frames of over ``trees.MAX_ROWS`` rows stay distributed (``spread_trees``).
"""
from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as E
from . import prep as PR
from . import resample as RS
from . import trees as T
from ..session import cut_computed, cut_lineage, in_parts
from .split import SEED, class_counts, stratified_folds

# Estimator names, scorer names, and search spaces.
ESTIMATORS = ("logreg", "balanced_rf", "hist_gb", "xgboost")
SCORERS = ("pr_auc", "roc_auc", "recall_fail", "f1_fail", "balanced_acc", "g_mean", "mcc")
PARAM_GRIDS = {
    "logreg": {"C": [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]},
    "balanced_rf": {"n_estimators": [200, 300, 500], "max_depth": [None, 6, 10, 20],
                    "min_samples_leaf": [1, 2, 5], "max_features": ["sqrt", "log2", 0.3]},
    "hist_gb": {"learning_rate": [0.03, 0.05, 0.1], "max_iter": [200, 300, 500],
                "max_leaf_nodes": [15, 31, 63], "l2_regularization": [0.0, 1.0, 10.0]},
    "xgboost": {"n_estimators": [300, 500, 800], "max_depth": [3, 4, 6], "learning_rate": [0.03, 0.05, 0.1],
                "subsample": [0.8, 1.0], "colsample_bytree": [0.7, 0.9], "min_child_weight": [1, 3, 5]},
}
DEFAULT_PARAMS = {
    "logreg": {"C": 1.0, "max_iter": 5000},
    "balanced_rf": {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 1, "max_features": "sqrt"},
    "hist_gb": {"learning_rate": 0.1, "max_iter": 300, "max_leaf_nodes": 31, "l2_regularization": 1.0, "min_samples_leaf": 20},
    "xgboost": {"n_estimators": 400, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.9,
                "colsample_bytree": 0.8, "min_child_weight": 1, "l2_regularization": 1.0},
}
DEFAULT_CONFIGS = [("logreg", "smote_enn"), ("logreg", "class_weight"), ("balanced_rf", "none"),
                   ("hist_gb", "class_weight"), ("xgboost", "none")]


log = logging.getLogger(__name__)
THREADS = 2                          # Spark ML fits submitted side by side: each iteration is a job, and every job's memory is the driver's
ROWS_A_PARTITION = 50_000


def _params(name: str, params: dict | None) -> dict:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator is called {name!r}; there are {', '.join(ESTIMATORS)}")
    p = {**DEFAULT_PARAMS[name], **(params or {})}
    return {**p, "n_trees": p.get("max_iter", p.get("n_estimators"))}


def _logreg(p: dict, sum_w: float) -> LogisticRegression:
    return LogisticRegression(regParam=1.0 / (p["C"] * sum_w), elasticNetParam=0.0, standardization=False,
                              maxIter=int(p["max_iter"]), featuresCol="features_vec", labelCol="label", weightCol="weight")


@dataclass
class SensorModel:
    """D14: preparation + estimator + threshold + feature names + metadata."""
    prep: PR.PrepModel
    model: object
    estimator: str
    strategy: str
    threshold: float = E.DEFAULT_THRESHOLD
    metadata: dict = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        return self.prep.feature_names

    def score(self, df: DataFrame, x: str = "x") -> DataFrame:
        """``score`` = P(fail) (PRJ-11: the probability column's positive entry)."""
        return self.score_prepared(self.prep.transform(df, x, "features"))

    def score_prepared(self, df: DataFrame) -> DataFrame:
        """``score`` of rows whose ``features`` stand already."""
        out = self.model.transform(df.withColumn("features_vec", array_to_vector("features")))
        return out.withColumn("score", F.get(vector_to_array("probability"), 1)).drop(
            "features_vec", "rawPrediction", "probability", "prediction")

    def predict_frame(self, df: DataFrame, x: str = "x") -> DataFrame:
        return E.predict_frame(self.score(df, x), self.threshold)

    def describe(self) -> str:
        return (f"{self.estimator} + {self.strategy}, {len(self.feature_names)} features, "
                f"threshold {self.threshold:.4f}")


def _weights(counts: dict, strategy: str, estimator: str) -> dict:
    """Per-class weights from the WHOLE training target (not per fold)."""
    n, k = sum(counts.values()), len(counts)
    if strategy == "class_weight":
        return {c: n / (k * v) for c, v in counts.items()}
    if estimator == "xgboost":
        pos = counts.get(1, 0)
        spw = (n - pos) / pos if pos else 1.0
        return {c: (spw if c == 1 else 1.0) for c in counts}
    return {c: 1.0 for c in counts}


def _weight_col(y: str, weights: dict):
    expr = None
    for c, w in weights.items():
        expr = F.when(F.col(y) == F.lit(c), F.lit(float(w))) if expr is None else expr.when(F.col(y) == F.lit(c), F.lit(float(w)))
    return expr.otherwise(F.lit(1.0))


def _resampled(prepared: DataFrame, strategy: str, y: str, seed: int) -> DataFrame:
    """(unit_id, y, features) after the strategy's sampler; ``prepared`` is held, for the samplers read it several times."""
    plan = RS.build_plan(strategy, y=y, id_col="unit_id", x="features", seed=seed)
    out = prepared if plan.sampler is None else plan.sampler(prepared)
    return out.select("unit_id", y, "features")


def _fit_frames(frames: dict[int, DataFrame], models: list[dict], y: str, seed: int) -> list:
    """One fitted model per entry of ``models`` ({frame, estimator, params, weights}); ``frames`` are held (unit_id, y,
    features). Trees of all models come from one job; Spark ML fits run side by side."""
    out: list = [None] * len(models)
    trees = [m for m, spec in enumerate(models) if spec["estimator"] != "logreg"]
    if trees:
        used, rows = sorted({models[m]["frame"] for m in trees}), None
        for i in used:
            part = frames[i].select(F.lit(i).alias("frame"), "unit_id", F.col(y).alias("y"), "features")
            rows = part if rows is None else rows.unionByName(part)
        for m, fitted in zip(trees, T.fit_trees(rows, [models[m] for m in trees], seed)):
            out[m] = fitted

    def logistic(m: int) -> None:
        spec = models[m]
        f = (frames[spec["frame"]].withColumn("weight", _weight_col(y, spec["weights"])).withColumn("label", F.col(y).cast("double"))
             .withColumn("features_vec", array_to_vector("features")))
        out[m] = _logreg(spec["params"], f.agg(F.sum("weight")).first()[0]).fit(f)

    with ThreadPoolExecutor(max_workers=THREADS) as pool:
        list(pool.map(logistic, [m for m, spec in enumerate(models) if spec["estimator"] == "logreg"]))
    return out


def _spec(frame: int, estimator: str, strategy: str, params: dict | None, weights: dict) -> dict:
    if estimator == "balanced_rf" and strategy != "none":
        log.warning("balanced_rf draws balanced samples by itself; with strategy %r rows are balanced twice", strategy)
    return {"frame": frame, "estimator": estimator, "params": _params(estimator, params), "weights": weights}


def fit_models(train: DataFrame, configs: list[tuple], weights: dict | None = None, seed: int = SEED,
               k_features: int | None = None, y: str = "y") -> list[SensorModel]:
    """TRN-09 fit step for several (estimator, strategy, params): one preparation on ``train``, one resampled frame a
    strategy, then the estimators."""
    counts = class_counts(train, y)
    train = train.select("unit_id", y, "x").persist(StorageLevel.MEMORY_AND_DISK)
    held = [train]
    try:
        prep = PR.fit(train, k_features=k_features)
        rows = sum(counts.values())
        prepared = cut_computed(prep.transform(train, "x", "features").select("unit_id", y, "features"), rows)
        strategies = list(dict.fromkeys(s for _, s, _ in configs))
        frames = {}
        for i, strategy in enumerate(strategies):
            frames[i] = _few_partitions(_resampled(prepared, strategy, y, seed), rows).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(frames[i])
        specs = [_spec(strategies.index(s), e, s, p, weights or _weights(counts, s, e)) for e, s, p in configs]
        fitted = _fit_frames(frames, specs, y, seed)
    finally:
        for f in held:
            f.unpersist()
    return [SensorModel(prep, m, e, s, metadata={"params": dict(p or {})}) for m, (e, s, p) in zip(fitted, configs)]


def fit_sensor_model(train: DataFrame, estimator: str = "logreg", strategy: str = "smote_enn",
                     params: dict | None = None, weights: dict | None = None, seed: int = SEED,
                     k_features: int | None = None, y: str = "y") -> SensorModel:
    """TRN-09 fit step: prep on ``train`` -> resample -> weights -> estimator."""
    return fit_models(train, [(estimator, strategy, params)], weights, seed, k_features, y)[0]


def _few_partitions(df: DataFrame, rows: int) -> DataFrame:
    """Small frames in few partitions: every iteration of a fit is a task a partition."""
    return df.coalesce(max(1, -(-rows // ROWS_A_PARTITION)))


# ---------------------------------------------------------------- CV
class Folds:
    """The k folds of a training split, prepared once: a preparation per fold, fitted outside of it, all rows as each
    of them prepares them, in one checkpoint, and the resampled training frames, held until ``close``. ``out`` is the
    fold that a preparation and a frame leave out; strategies that know groups resample all folds in the same jobs, so
    that the driver's work and memory do not grow with the folds."""

    def __init__(self, train: DataFrame, k: int = 5, seed: int = SEED, y: str = "y", k_features: int | None = None):
        self.k, self.seed, self.y = k, seed, y
        self.counts = class_counts(train, y)
        rows = sum(self.counts.values())
        self.folded = _few_partitions(stratified_folds(train, k, y, "unit_id", seed).select("unit_id", y, "x", "fold"), rows)
        self.folded = self.folded.persist(StorageLevel.MEMORY_AND_DISK)
        self._held, self._frames, self._prepared = [self.folded], {}, None
        self._rows = rows
        if k_features is None:
            self.preps = PR.fit_folds(self.folded, k)
        else:
            self.preps = [PR.fit(self.folded.where(F.col("fold") != i), k_features=k_features) for i in range(k)]

    def _all(self) -> DataFrame:
        """(out, unit_id, y, fold, features): all rows by every preparation."""
        if self._prepared is None:
            every = None
            for i, prep in enumerate(self.preps):
                part = prep.transform(self.folded, "x", "features").select(F.lit(i).alias("out"), "unit_id", self.y, "fold", "features")
                every = part if every is None else every.unionByName(part)
            self._prepared = cut_computed(every, self._rows * self.k)
        return self._prepared

    def prepared(self, i: int) -> DataFrame:
        """(unit_id, y, fold, features) of all rows by the preparation of fold i."""
        return self._all().where(F.col("out") == i).drop("out")

    def scored(self) -> DataFrame:
        """(unit_id, y, fold, features) of all rows by the preparation of their own fold, held."""
        if "scored" not in self._frames:
            own = self._all().where(F.col("fold") == F.col("out")).drop("out")
            self._frames["scored"] = _few_partitions(own, self._rows).persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(self._frames["scored"])
        return self._frames["scored"]

    def training(self, i: int, strategy: str) -> DataFrame:
        """(unit_id, y, features) of the rows outside fold i, resampled."""
        if strategy == "class_weight":
            strategy = "none"
        if (i, strategy) not in self._frames:
            if strategy in RS.GROUPED:
                frame = self._resampled_all(strategy).where(F.col("out") == i).drop("out")
            else:
                outside = self.prepared(i).where(F.col("fold") != i).select("unit_id", self.y, "features")
                frame = _resampled(outside, strategy, self.y, self.seed)
            self._frames[i, strategy] = _few_partitions(frame, self._rows).persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(self._frames[i, strategy])
        return self._frames[i, strategy]

    def _resampled_all(self, strategy: str) -> DataFrame:
        """(out, unit_id, y, features) of every fold's training rows, checkpointed."""
        if strategy not in self._frames:
            outside = self._all().where(F.col("fold") != F.col("out")).select("out", "unit_id", self.y, "features")
            plan = RS.build_plan(strategy, y=self.y, id_col="unit_id", x="features", seed=self.seed, group="out")
            self._frames[strategy] = outside if plan.sampler is None else cut_computed(
                plan.sampler(outside).select("out", "unit_id", self.y, "features"), 2 * self._rows * self.k)
        return self._frames[strategy]

    def close(self) -> None:
        for f in self._held:
            f.unpersist()

    def __enter__(self) -> Folds:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def cross_validate_many(folds: Folds, configs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(config, fold, 7 scorers) and the out-of-fold scores (config, fold, unit_id, y, score) of every
    (estimator, strategy, params); ``config`` is the place in the list."""
    y, strategies = folds.y, list(dict.fromkeys("none" if s == "class_weight" else s for _, s, _ in configs))
    keys = [(i, s) for s in strategies for i in range(folds.k)]
    frames = {n: folds.training(*key) for n, key in enumerate(keys)}
    place = {key: n for n, key in enumerate(keys)}
    wanted = [(c, i, e, s, p) for c, (e, s, p) in enumerate(configs) for i in range(folds.k)]
    specs = [_spec(place[i, "none" if s == "class_weight" else s], e, s, p, _weights(folds.counts, s, e)) for c, i, e, s, p in wanted]
    oof, trees = None, {}
    for (c, i, e, s, _), model in zip(wanted, _fit_frames(frames, specs, y, folds.seed)):
        if isinstance(model, T.TreeEnsemble):
            trees.setdefault(i, []).append((c, model))
            continue
        scored = SensorModel(folds.preps[i], model, e, s).score_prepared(folds.scored().where(F.col("fold") == i))
        scored = scored.select(F.lit(c).alias("config"), "fold", "unit_id", F.col(y).alias("y"), "score")
        oof = scored if oof is None else oof.unionByName(scored)
    if trees:
        scored = T.scored_together(folds.scored().select("fold", "unit_id", F.col(y).alias("y"), "features"), trees)
        oof = scored if oof is None else oof.unionByName(scored)
    oof, by = cut_lineage(oof), ["config", "fold"]
    points = E.curve_points(oof, "y", "score", by)
    at = E.metrics_at_threshold(oof, E.DEFAULT_THRESHOLD, "y", "score", by).select(
        *by, F.col("recall").alias("recall_fail"), F.col("f1").alias("f1_fail"), F.col("balanced_accuracy").alias("balanced_acc"), "g_mean", "mcc")
    ap = E.average_precision(points, by).withColumnRenamed("average_precision", "pr_auc")
    return cut_lineage(ap.join(E.roc_auc(points, by), by).join(at, by).select(*by, *SCORERS)), oof


def cross_validate(train: DataFrame, estimator: str, strategy: str, k: int = 5, params: dict | None = None,
                   seed: int = SEED, y: str = "y", k_features: int | None = None):
    """TRN-05 / TRN-08: per-fold metrics (7 scorers) and the out-of-fold scores
    of every training row. Returns (fold_metrics DataFrame, oof DataFrame)."""
    with Folds(train, k, seed, y, k_features) as folds:
        metrics, oof = cross_validate_many(folds, [(estimator, strategy, params)])
    return metrics.drop("config"), oof.select("unit_id", F.col("y").alias(y), "score", "fold")


def _means(metrics: DataFrame, by=()) -> DataFrame:
    """Mean and population std (ddof=0) per scorer."""
    aggs = []
    for s in SCORERS:
        aggs += [F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std")]
    return metrics.groupBy(*by).agg(*aggs)


def cv_summary(metrics: DataFrame, estimator: str, strategy: str) -> DataFrame:
    """Mean and population std (ddof=0) per scorer: one row."""
    return _means(metrics).select(F.lit(estimator).alias("estimator"), F.lit(strategy).alias("strategy"), "*")


def compare_configs(train: DataFrame, configs=None, k: int = 5, params: dict | None = None,
                    seed: int = SEED) -> DataFrame:
    """TRN-06 / SRT-03: CV every (estimator, strategy) on the training split,
    sorted by mean PR-AUC (descending)."""
    configs = list(configs or DEFAULT_CONFIGS)
    with Folds(train, k, seed) as folds:
        metrics, _ = cross_validate_many(folds, [(e, s, (params or {}).get(e)) for e, s in configs])
    names = train.sparkSession.createDataFrame([(c, e, s) for c, (e, s) in enumerate(configs)], "config int, estimator string, strategy string")
    out = _means(metrics, ["config"]).join(F.broadcast(names), "config").drop("config")
    return out.select("estimator", "strategy", *[c for c in out.columns if c not in ("estimator", "strategy")]).orderBy(
        F.col("pr_auc_mean").desc_nulls_last(), "estimator", "strategy")


def draw_params(estimator: str, n_iter: int = 25, seed: int = SEED) -> list[dict]:
    """TRN-07 draws: hash-ranked combinations of the estimator's grid (without
    replacement when the grid is small enough)."""
    import itertools
    import hashlib
    grid = PARAM_GRIDS[estimator]
    keys = sorted(grid)
    combos = [dict(zip(keys, v)) for v in itertools.product(*[grid[k_] for k_ in keys])]
    combos.sort(key=lambda d: hashlib.md5(f"{sorted(d.items())}:{seed}".encode()).hexdigest())
    return combos[:n_iter]


def tune(train: DataFrame, estimator: str, strategy: str, n_iter: int = 25, k: int = 5, seed: int = SEED,
         base_params: dict | None = None):
    """TRN-07: randomized search scored by mean PR-AUC; refit the best on all
    of ``train``. Returns (best model, best params, best score, all results)."""
    drawn = draw_params(estimator, n_iter, seed)
    with Folds(train, k, seed) as folds:
        metrics, _ = cross_validate_many(folds, [(estimator, strategy, {**(base_params or {}), **p}) for p in drawn])
    mean = {r["config"]: r["pr_auc"] for r in metrics.groupBy("config").agg(F.avg("pr_auc").alias("pr_auc")).collect()}   # a row a draw
    results = [(str(p), mean.get(c)) for c, p in enumerate(drawn)]
    i_best = max(range(len(results)), key=lambda j: results[j][1] if results[j][1] is not None else float("-inf"))
    best, best_s = {**(base_params or {}), **drawn[i_best]}, results[i_best][1]
    model = fit_sensor_model(train, estimator, strategy, best, seed=seed)
    table = train.sparkSession.createDataFrame(results, "params string, pr_auc double")
    return model, best, best_s, table


def fit_select_threshold_evaluate(train: DataFrame, test: DataFrame, estimator: str = "logreg",
                                  strategy: str = "smote_enn", params: dict | None = None, k: int = 5,
                                  objective: str = "f1", recall_target: float | None = None, seed: int = SEED):
    """TRN-08/09 + EVL-17: threshold from out-of-fold scores on the training
    split, final fit on all of it, report on the test split."""
    _, oof = cross_validate(train, estimator, strategy, k, params, seed)
    pts = E.curve_points(oof, "y", "score").cache()
    if recall_target is not None:
        thr = E.tune_recall(pts, recall_target).first()["threshold"]
    elif objective == "g_mean":
        thr = E.tune_gmean(pts).first()["threshold"]
    else:
        thr = E.tune_f1(pts).first()["threshold"]
    model = fit_sensor_model(train, estimator, strategy, params, seed=seed)
    model.threshold = float(thr)
    scored = model.score(test).cache()
    report = E.evaluation_report(scored, tuned_threshold=float(thr))
    return model, report, scored


def holdout_comparison(train: DataFrame, test: DataFrame, configs=None, params: dict | None = None,
                       k: int = 5, seed: int = SEED) -> DataFrame:
    """TRN-10: one row per configuration with test metrics (rounded to 3) and
    ``*`` on the best cross-validated PR-AUC."""
    configs = list(configs or DEFAULT_CONFIGS)
    cmp_ = compare_configs(train, configs, k, params, seed)
    models, scored = fit_models(train, [(e, s, (params or {}).get(e)) for e, s in configs], seed=seed), None
    prepared = cut_computed(models[0].prep.transform(test, "x", "features").select("y", "features"))      # one for all models
    for c, m in enumerate(models):
        part = m.score_prepared(prepared).select(F.lit(c).alias("config"), "y", "score")
        scored = part if scored is None else scored.unionByName(part)
    scored = cut_lineage(scored)
    points = E.curve_points(scored, "y", "score", ["config"])
    names = train.sparkSession.createDataFrame([(c, e, s) for c, (e, s) in enumerate(configs)], "config int, estimator string, strategy string")
    rows = (E.metrics_at_threshold(scored, E.DEFAULT_THRESHOLD, group_cols=["config"])
            .join(E.average_precision(points, ["config"]).withColumnRenamed("average_precision", "test_pr_auc"), "config")
            .join(E.roc_auc(points, ["config"]).withColumnRenamed("roc_auc", "test_roc_auc"), "config").join(F.broadcast(names), "config"))
    best = cmp_.select("estimator", "strategy").limit(1).withColumn("best", F.lit("*"))
    out = rows.join(best, ["estimator", "strategy"], "left").fillna({"best": ""})
    return out.select("estimator", "strategy", *[F.round(c, 3).alias(c) for c in
                                                  ("test_pr_auc", "test_roc_auc", "recall", "f1", "mcc")], "best")


def feature_importance(m: SensorModel, test: DataFrame | None = None, n_repeats: int = 10) -> DataFrame:
    """EVL-11: |coefficients| for linear models, share of the gain for forests and xgboost; hist_gb has none of its own and takes
    ``permutation_importance`` on ``test``. One row per model feature (permutation: per input)."""
    from pyspark.sql import SparkSession
    names = m.feature_names
    if hasattr(m.model, "coefficients"):
        imp, method = [abs(v) for v in m.model.coefficients.toArray()], "coef"
    elif m.estimator == "hist_gb" and test is not None:
        return permutation_importance(m, test, n_repeats).orderBy(F.col("importance").desc(), "feature")
    else:
        imp, method = m.model.importances(len(names)), "tree"
    rows = [(n, float(v), 0.0, method) for n, v in zip(names, imp)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double, std double, method string") \
        .orderBy(F.col("importance").desc(), "feature")


def permuted(test: DataFrame, features: list[int], n_repeats: int, seed: int = SEED, id_col: str = "unit_id", x: str = "x") -> DataFrame:
    """``test`` once per (feature, repeat), that slot of ``x`` taken from another row: the row of rank r in one seeded
    order receives the value of the row of rank r in an order drawn for the pair. One ranking, one join for all pairs."""
    from .split import seeded_rank
    ranked = seeded_rank(test, id_col, (), seed)
    pairs = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for r in range(n_repeats)])
                                          for f in features])))
    donors = test.select(id_col, x, pairs.alias("p")).select(
        F.col("p.feature").alias("feature"), F.col("p.repeat").alias("repeat"), F.get(x, F.col("p.feature")).alias("_v"),
        F.concat_ws(":", F.col(id_col).cast("string"), F.col("p.feature").cast("string"), F.col("p.repeat").cast("string")).alias("_id"))
    donors = seeded_rank(donors, "_id", ["feature", "repeat"], seed + 1).drop("_id")
    out = ranked.join(donors, "rank")
    return out.withColumn(x, F.transform(x, lambda v, j: F.when(j == F.col("feature"), F.col("_v")).otherwise(v))).drop("rank", "_v")


def permutation_importance(m: SensorModel, test: DataFrame, n_repeats: int = 10, seed: int = SEED,
                           features: list[int] | None = None) -> DataFrame:
    """EVL-11: drop in average precision when one input slot is permuted, mean and population std over
    ``n_repeats``. All (feature, repeat) pairs are scored in one job, their curves are one grouped curve."""
    base = E.average_precision(E.curve_points(m.score(test), "y", "score")).first()[0]
    names = m.prep.names_in
    features = list(range(len(names))) if features is None else list(features)
    by = ["feature", "repeat"]
    scored = cut_lineage(m.score(permuted(test, features, n_repeats, seed)).select(*by, "y", "score"))
    ap = E.average_precision(E.curve_points(scored, "y", "score", by), by)
    drops = ap.groupBy("feature").agg(F.avg(F.lit(base) - F.col("average_precision")).alias("importance"),
                                      F.stddev_pop(F.lit(base) - F.col("average_precision")).alias("std"))
    listed = F.array(*[F.lit(n) for n in names])
    return drops.select(F.get(listed, F.col("feature")).alias("feature"), "importance", "std", F.lit("permutation").alias("method"))


# ------------------------------------------------------------- TRN-12
MAX_CLASSES = 1000
VALUES_A_ROW = 512                   # a map counts as so many rows of 512 values


def fit_wafer_classifier(train: DataFrame, classes: list[str], x: str = "x", label: str = "label",
                         method: str = "rf", n_trees: int = 100, seed: int = SEED, weights: bool = True):
    """TRN-12 (re-aimed): multiclass wafer-pattern classifier on resized,
    normalised maps. Class weights = inverse frequency normalised to mean 1.

    Rows whose map is null or whose label is null or not in ``classes`` are not trained on; more than
    ``MAX_CLASSES`` classes raise, as do rows of which none is left."""
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"at most {MAX_CLASSES} classes; got {len(classes)}")
    train = train.filter(F.col(label).isin(list(classes)) & F.col(x).isNotNull())
    if train.isEmpty():
        raise ValueError("no row has a map and one of the classes")
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    d = train.withColumn("label_idx", idx.cast("double")).withColumn("features_vec", array_to_vector(x))
    if weights:
        counts = {r[label]: r["count"] for r in d.groupBy(label).count().collect()}
        n = sum(counts.values())
        raw = {c: (n / counts[c] if counts.get(c) else 1.0) for c in classes}
        mean = sum(raw.values()) / len(raw)
        d = d.withColumn("weight", _weight_col(label, {c: raw[c] / mean for c in classes}))
    else:
        n, d = d.count(), d.withColumn("weight", F.lit(1.0))
    width = d.select(F.size(x)).first()[0]
    # every level of the trees is a task a part: as few as the values fill
    d = in_parts(d.select("label_idx", "features_vec", "weight"), -(-n * width // VALUES_A_ROW)).persist(StorageLevel.MEMORY_AND_DISK)
    if method == "mlp":
        est = MultilayerPerceptronClassifier(layers=[width, 64, len(classes)], seed=seed, maxIter=200,
                                             featuresCol="features_vec", labelCol="label_idx")
    else:
        est = RandomForestClassifier(numTrees=n_trees, maxDepth=10, seed=seed, featuresCol="features_vec",
                                     labelCol="label_idx", weightCol="weight")
    try:
        return est.fit(d)
    finally:
        d.unpersist()


def classify_wafers(model, maps: DataFrame, classes: list[str], x: str = "x") -> DataFrame:
    """RTE-06 scoring: probabilities -> decode (argmax, label, rounded confidence)."""
    out = model.transform(maps.withColumn("features_vec", array_to_vector(x)))
    probs = vector_to_array("probability")
    out = out.withColumn("probs", probs).withColumn("pred", (F.array_position("probs", F.array_max("probs")) - 1)
                                                    .cast("int"))
    names = F.array(*[F.lit(c) for c in classes])
    return (out.withColumn("pattern", F.coalesce(F.get(names, F.col("pred")),
                                                  F.concat(F.lit("class_"), F.col("pred").cast("string"))))
            .withColumn("confidence", F.bround(F.array_max("probs"), 4))
            .withColumn("probabilities", F.transform("probs", lambda v: F.bround(v, 4)))
            .drop("features_vec", "rawPrediction", "probability", "prediction"))

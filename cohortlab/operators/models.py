"""Binary classifiers and their score tables.

Five estimators as the reference sets them up. C1 and C3 are second-order boosters
of ``operators/boosting.py``: one round, level by level, with the step and the L2
term in the leaf weights; and a hundred rounds on binned features, best leaf first.
The other three are Spark's own.

Scoring applies every fitted model to the prepared rows in one pass (the
models run one after another inside the same projection) and then turns the
wide row into one row per model — one scan of the features instead of one per
model and split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import (LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.columns import match_flag
from cohortlab.operators.boosting import BoostedTreesClassifier, BoostedTreesModel
from cohortlab.operators.features import vector_to_array

MODEL_NAMES = ("boosted_one_round", "random_forest", "linear_svc", "logistic",
               "boosted_many_rounds")  # the order of the reference's five scores

# The reference's settings for its boosted models. One round: eta 0.3,
# max depth 6, gamma 0, all columns per level, and the method's defaults of lambda 1,
# child weight 1 and base margin 0. Many rounds: the library defaults of 100 rounds at
# rate 0.1, 31 leaves, 255 bins, 20 rows and a hessian of 0.001 a leaf, base margin from
# the label's mean.
ONE_ROUND = {"rounds": 1, "step": 0.3, "leaves": None, "depth": 6, "gamma": 0.0, "l2": 1.0,
             "min_rows": 1, "min_hessian": 1.0, "from_mean": False, "bins": 255}
MANY_ROUNDS = {"rounds": 100, "step": 0.1, "leaves": 31, "depth": None, "gamma": 0.0, "l2": 0.0,
               "min_rows": 20, "min_hessian": 1e-3, "from_mean": True, "bins": 255}
SEED = 12345  # the reference's seed, reused for the tree models


def _boosted_one_round(label, features, seed, **kw):
    return BoostedTreesClassifier(label, features, **{**ONE_ROUND, **kw})


def _random_forest(label, features, seed, **kw):
    return RandomForestClassifier(labelCol=label, featuresCol=features, seed=seed, **kw)


def _boosted_many_rounds(label, features, seed, **kw):
    return BoostedTreesClassifier(label, features, **{**MANY_ROUNDS, **kw})


def _linear_svc(label, features, seed, **kw):
    return LinearSVC(labelCol=label, featuresCol=features, **kw)


def _logistic(label, features, seed, **kw):
    return LogisticRegression(labelCol=label, featuresCol=features, **kw)


ESTIMATORS: dict[str, Callable] = {
    "boosted_one_round": _boosted_one_round,
    "random_forest": _random_forest,
    "boosted_many_rounds": _boosted_many_rounds,
    "linear_svc": _linear_svc,
    "logistic": _logistic,
}


LOADERS = {"random_forest": RandomForestClassificationModel, "linear_svc": LinearSVCModel,
           "logistic": LogisticRegressionModel}


def estimator(name: str, label_col: str = "label", features_col: str = "scaledFeatures",
              seed: int = SEED, **kw):
    if name not in ESTIMATORS:
        raise KeyError(f"unknown model {name!r}; one of {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](label_col, features_col, seed, **kw)


def fit_models(train: DataFrame, names: Sequence[str] = MODEL_NAMES, label_col: str = "label",
               features_col: str = "scaledFeatures", seed: int = SEED,
               params: dict[str, dict] | None = None) -> dict:
    """Fit each named model on ``train`` (the caller persists ``train``:
    the fits iterate over it). Rows without a label are left out of the fit."""
    params = params or {}
    train = (train.filter(F.col(label_col).isNotNull())
             .withColumn(label_col, F.col(label_col).cast("double")))
    return {n: estimator(n, label_col, features_col, seed, **params.get(n, {})).fit(train)
            for n in names}


def save_model(model, path: str) -> None:
    """Write a fitted model of ``fit_models``."""
    if isinstance(model, BoostedTreesModel):
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(path)
    else:
        model.write().save(path)


def load_model(name: str, path: str):
    """Read a model that ``save_model`` wrote."""
    if name in LOADERS:
        return LOADERS[name].load(path)
    text = SparkSession.getActiveSession().read.text(path, wholetext=True).first()[0]
    return BoostedTreesModel.from_json(text)


def _scored(model, df: DataFrame, pred: str, score: str, tag: str) -> DataFrame:
    """``df`` with a model's hard prediction and positive-class score."""
    if isinstance(model, BoostedTreesModel):
        return model.transform(df, f"_margin{tag}", score, pred)
    m, raw, prob = model.copy(), f"_raw{tag}", f"_prob{tag}"
    m.setPredictionCol(pred)
    m.setRawPredictionCol(raw)
    if m.hasParam("probabilityCol"):
        m.setProbabilityCol(prob)
    positive = prob if m.hasParam("probabilityCol") else raw
    return m.transform(df).withColumn(score, vector_to_array(positive).getItem(1))


def score_splits(models: dict, df: DataFrame | dict, id_cols: Sequence[str],
                 label_col: str = "label", split_col: str | None = "split") -> DataFrame:
    """Score ``df`` with every model; one row per (model, input row).

    ``df`` is one frame with a ``split_col`` column, or a dict of split name
    to frame (tagged and unioned, then scored in the same single pass).
    Output: ``model, [split], id..., label double, prediction double,
    score double, equal int``. ``score`` is the positive-class probability
    (raw margin for the SVC), for exact AUROC.
    """
    if isinstance(df, dict):
        split_col = split_col or "split"
        frames = [f.withColumn(split_col, F.lit(name)) for name, f in df.items()]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
    cur = df
    outs = []
    for i, (name, m) in enumerate(models.items()):
        pred, score = f"_pred{i}", f"_score{i}"
        cur = _scored(m, cur, pred, score, str(i))
        outs.append((name, pred, score))
    keep = ([split_col] if split_col else []) + list(id_cols)
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(p).alias("prediction"),
                              F.col(sc).alias("score")) for n, p, sc in outs])
    long = cur.select(*keep, F.col(label_col).cast("double").alias("label"), F.inline(rows))
    return long.select("model", *keep, "label", "prediction", "score",
                       match_flag("prediction", "label").alias("equal"))


def hinge_interval(rows: DataFrame, weights: Sequence[float], intercept: float, features_col: str, label_col: str,
                   names: Sequence[str], near: float = 1e-2, slack: float = 1e-3) -> DataFrame:
    """``term, n, low, high``: the interval of the mean hinge subgradient of a linear SVC by
    each feature and the intercept; at an optimum of the unpenalised loss each holds zero.

    Rows below the margin add ``-y x``, rows above it nothing, and rows whose margin is 1 up
    to ``near`` anything between. ``slack`` (in units of the feature's mean size) widens the
    interval by the tolerance of an iterative fit. One aggregate over the rows."""
    x, y = F.col("_x"), F.when(F.col("_y") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    dot = F.lit(float(intercept))
    for i, w in enumerate(weights):
        dot = dot + x[i] * F.lit(float(w))
    terms = [(n, x[i]) for i, n in enumerate(names)] + [("intercept", F.lit(1.0))]
    m = (rows.filter(F.col(label_col).isNotNull())
         .select(vector_to_array(features_col).alias("_x"), F.col(label_col).alias("_y"))
         .select("_x", y.alias("_s"), (y * dot).alias("_m")))
    below, at = F.col("_m") < 1 - near, F.abs(F.col("_m") - 1) <= near
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (_, t) in enumerate(terms):
        pull = -F.col("_s") * t
        aggs += [F.avg(F.when(below, pull).when(at, F.least(pull, F.lit(0.0))).otherwise(0.0)).alias(f"lo{i}"),
                 F.avg(F.when(below, pull).when(at, F.greatest(pull, F.lit(0.0))).otherwise(0.0)).alias(f"hi{i}"),
                 F.avg(F.abs(t)).alias(f"size{i}")]
    each = F.array(*[F.struct(F.lit(n).alias("term"), (F.col(f"lo{i}") - slack * F.col(f"size{i}")).alias("low"),
                              (F.col(f"hi{i}") + slack * F.col(f"size{i}")).alias("high"))
                     for i, (n, _) in enumerate(terms)])
    return m.agg(*aggs).select("n", F.inline(each)).select("term", "n", "low", "high")

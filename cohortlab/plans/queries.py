"""The registered queries: every operator of the library run over the whole
test tables (``queries()`` of the driver contract).

Conventions: doubles are rounded to 6 places in the output (the SQL oracle
rounds the same way, since summation order differs between engines); the
timestamp columns are left out of outputs; every computed column is aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cohortlab.functions.columns import contains, encode_binary, negate
from cohortlab.operators import align, features, metrics, models, profile, split, trees, wide_pca
from cohortlab.plans import model_data
from cohortlab.plans.catalog import (LI_CLASSES, LI_FEATURES, LI_KEYS, LI_LABEL, table)
from cohortlab.sources import csv as csv_src
from cohortlab.sources import views
from cohortlab.sources.cache import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DIGITS = 6

SALT = split.SEED  # the reference's split seed, used as the hash salt

# Plan choices for the lineitem stand-in (not from the reference): the
# positive and baseline classes, the radar order, and rule "models".
POSITIVE_CLASS = "R"
BASELINE_CLASS = "N"
LI_RADAR = ("l_discount", "l_quantity", "l_tax", "l_extendedprice")
LI_FAMILIES = {"all": LI_RADAR, "price": ("l_extendedprice", "l_discount")}
PRICE_RULE = 30000.0
RULES = {"price_rule": ("l_extendedprice", 30000.0), "qty_rule": ("l_quantity", 25.0),
         "discount_rule": ("l_discount", 0.05), "tax_rule": ("l_tax", 0.04)}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# ------------------------------------------------------------------ shared frames

def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").drop("l_shipdate")


def lineitem_scored(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with label (R), a rule prediction, a score and a 3-way split."""
    li = lineitem(spark, sf)
    li = li.withColumn("label", encode_binary(LI_LABEL, POSITIVE_CLASS))
    li = li.withColumn("prediction",
                       (F.col("l_extendedprice") > F.lit(PRICE_RULE)).cast("double"))
    li = li.withColumn("score", F.col("l_extendedprice"))
    return split.three_way_split(li, LI_KEYS, salt=SALT)


def customer_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """customer with nulls put in by a rule on the balance: the lower the
    balance, the more of the five columns are null (all five below 0)."""
    c = table(spark, sf, "customer")
    bal = F.col("c_acctbal")
    rule = [("c_custkey", 0.0), ("c_name", 1000.0), ("c_nationkey", 2500.0),
            ("c_mktsegment", 5000.0), ("c_acctbal", 7500.0)]
    return c.select(*[F.when(bal < F.lit(t), F.lit(None)).otherwise(F.col(n)).alias(n)
                      for n, t in rule])


def lineitem_records(spark: SparkSession, sf: str) -> DataFrame:
    """Key of the lowest record of each class (one small row per class)."""
    li = lineitem(spark, sf)
    return (li.groupBy(LI_LABEL).agg(F.min(F.struct(*LI_KEYS)).alias("k"))
            .select(LI_LABEL, "k.*"))


# ------------------------------------------------------------------ sources

@query("csv_scan")
def q_csv_scan(spark, sf):
    """Header and inferred types, as the reference reads its table."""
    path = csv_src.write_csv(table(spark, sf, "customer"), text_safe=False)
    got = csv_src.read_csv(spark, path)
    # inference has no 64-bit integers where 32 bits hold every value
    return got.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                      F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment", "c_acctbal")


@query("csv_text")
def q_csv_text(spark, sf):
    """Texts with line ends, quotes, nulls and empty strings through a CSV file."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 1, "")
        .when(F.col("doc_id") % 7 == 2, F.concat(F.lit('"'), F.col("text"), F.lit(' "", \r\n x\\')))
        .otherwise(F.col("text")).alias("text"), "lang")
    path = csv_src.write_csv(d)
    return csv_src.read_csv(spark, path, schema=d.schema, text_safe=True)


@query("view_sql")
def q_view_sql(spark, sf):
    return rounded(views.view_sql(
        spark,
        "SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS avg_qty, "
        "max(l_extendedprice) AS max_price FROM cohort_lineitem "
        "WHERE l_discount >= :d GROUP BY l_returnflag",
        views={"cohort_lineitem": lineitem(spark, sf)}, args={"d": 0.05}))


# ------------------------------------------------------------------ projections

@query("drop_null_heavy_rows")
def q_drop_null_heavy_rows(spark, sf):
    return profile.drop_null_heavy_rows(customer_with_nulls(spark, sf), frac=0.9)


@query("row_null_count")
def q_row_null_count(spark, sf):
    return profile.with_null_count(customer_with_nulls(spark, sf))


@query("encode_label")
def q_encode_label(spark, sf):
    li = profile.encode_label(lineitem(spark, sf), LI_LABEL, POSITIVE_CLASS, out="label")
    return li.select(*LI_KEYS, LI_LABEL, "label")


@query("cast_label")
def q_cast_label(spark, sf):
    li = profile.encode_label(lineitem(spark, sf), LI_LABEL, POSITIVE_CLASS, out="label")
    return metrics.cast_label(li.select(*LI_KEYS, "label"), "label", "double")


@query("project_mean")
def q_project_mean(spark, sf):
    return profile.project_family(lineitem(spark, sf), "key", lead=(LI_LABEL,))


@query("project_se")
def q_project_se(spark, sf):
    return rounded(profile.project_family(lineitem(spark, sf), "price"))


@query("project_worst")
def q_project_worst(spark, sf):
    return profile.project_family(lineitem(spark, sf), "status")


@query("class_subset")
def q_class_subset(spark, sf):
    out = profile.class_subset(table(spark, sf, "lineitem"), LI_LABEL, POSITIVE_CLASS)
    return rounded(out.withColumn("l_shipdate", F.col("l_shipdate").cast("string")))


@query("str_contains")
def q_str_contains(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderpriority",
                    contains("o_orderpriority", "URGENT").alias("is_urgent"))


@query("logical_not")
def q_logical_not(spark, sf):
    o = table(spark, sf, "orders")
    return (o.filter(negate(contains("o_orderpriority", "URGENT")))
            .select("o_orderkey", "o_orderpriority"))


@query("point_lookup")
def q_point_lookup(spark, sf):
    o = table(spark, sf, "orders")
    keys = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))
    return rounded(profile.point_lookup(
        o, "o_orderkey", keys, cols=["o_custkey", "o_orderstatus", "o_totalprice",
                                     "o_orderpriority"]))


@query("point_lookup_ntz")
def q_point_lookup_ntz(spark, sf):
    """Lookup by a wall-clock timestamp (no time zone)."""
    o = table(spark, sf, "orders")
    keys = o.groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("o_orderdate"))
    out = profile.point_lookup(o, "o_orderdate", keys, cols=["o_orderkey", "o_orderpriority"])
    return out.select("o_orderkey", "o_orderpriority")


@query("point_lookup_many")
def q_point_lookup_many(spark, sf):
    """Line items of the urgent orders, by a key table that is not broadcast."""
    keys = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return profile.point_lookup(table(spark, sf, "lineitem"), "l_orderkey", keys,
                                cols=["l_linenumber", "l_returnflag"], max_broadcast_rows=0)


@query("select_columns")
def q_select_columns(spark, sf):
    return rounded(align.select_columns(lineitem(spark, sf), "l_orderkey", "l_quantity",
                                        "l_returnflag"))


@query("drop_column")
def q_drop_column(spark, sf):
    return rounded(align.drop_column(table(spark, sf, "lineitem"), "l_shipdate", "l_linestatus"))


# ------------------------------------------------------------------ profile

@query("class_profile")
def q_class_profile(spark, sf):
    return rounded(profile.class_profile(lineitem(spark, sf), LI_LABEL, LI_FEATURES))


@query("describe_table")
def q_describe_table(spark, sf):
    return rounded(profile.describe_columns(table(spark, sf, "lineitem")))


@query("class_avg")
def q_class_avg(spark, sf):
    st = profile.class_stats(lineitem(spark, sf), LI_LABEL, LI_FEATURES)
    return rounded(st.select(LI_LABEL, "attribute", "avg_value"))


@query("class_min")
def q_class_min(spark, sf):
    st = profile.class_stats(lineitem(spark, sf), LI_LABEL, LI_FEATURES)
    return rounded(st.select(LI_LABEL, "attribute", "min_value"))


@query("class_max")
def q_class_max(spark, sf):
    st = profile.class_stats(lineitem(spark, sf), LI_LABEL, LI_FEATURES)
    return rounded(st.select(LI_LABEL, "attribute", "max_value"))


@query("row_count")
def q_row_count(spark, sf):
    return metrics.row_count(lineitem(spark, sf), [LI_LABEL])


@query("min_max_scale")
def q_min_max_scale(spark, sf):
    out = profile.scale_by_class(lineitem(spark, sf), LI_LABEL, LI_FEATURES)
    return rounded(out.select(*LI_KEYS, LI_LABEL, *[f"{c}_scaled" for c in LI_FEATURES]))


@query("baseline_profile")
def q_baseline_profile(spark, sf):
    # one row per class and measure, read twice below
    st = cut_lineage(profile.class_stats(lineitem(spark, sf), LI_LABEL, LI_FEATURES))
    return rounded(profile.baseline_profile(st, LI_LABEL, scale_by="baseline_class",
                                            baseline_class=BASELINE_CLASS))


def _records(spark, sf):
    li = lineitem(spark, sf)
    st = cut_lineage(profile.class_stats(li, LI_LABEL, LI_FEATURES))
    return profile.record_profile(li, list(LI_KEYS), LI_LABEL, LI_FEATURES,
                                  keys=lineitem_records(spark, sf), stats=st), st


@query("record_profile")
def q_record_profile(spark, sf):
    rec, _ = _records(spark, sf)
    return rounded(rec)


@query("radar_table")
def q_radar_table(spark, sf):
    rec, st = _records(spark, sf)
    base = profile.baseline_profile(st, LI_LABEL)
    return rounded(profile.radar_table(base, rec, LI_LABEL, LI_FAMILIES,
                                       BASELINE_CLASS, LI_CLASSES))


# ------------------------------------------------------------------ align

def _orders_indexed(spark, sf, cols):
    o = table(spark, sf, "orders").select("o_orderkey", *cols)
    return align.row_index(o, ["o_orderkey"])


@query("row_index")
def q_row_index(spark, sf):
    return rounded(_orders_indexed(spark, sf, ["o_totalprice"]))


@query("positional_join")
def q_positional_join(spark, sf):
    left = _orders_indexed(spark, sf, ["o_custkey"])
    right = _orders_indexed(spark, sf, ["o_totalprice", "o_orderpriority"]).drop("o_orderkey")
    return rounded(align.positional_join(left, right, "index"))


@query("ranked_join")
def q_ranked_join(spark, sf):
    """The rows of ``positional_join``, from two tables cut at the same ranks."""
    left = _orders_indexed(spark, sf, ["o_custkey"])
    right = _orders_indexed(spark, sf, ["o_totalprice", "o_orderpriority"]).drop("o_orderkey")
    return rounded(align.ranked_join(*align.ranked_tables([left, right])))


# ------------------------------------------------------------------ splits

@query("split_exact")
def q_split_exact(spark, sf):
    """Exactly four fifths of the orders of every priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.exact_split(o, ["o_orderkey"], "o_orderpriority")


@query("pca_wide")
def q_pca_wide(spark, sf):
    """Explained variance by randomised subspace iteration, on the rows of ``pca_explained``."""
    scaled, _ = _pca_fitted(spark, sf)
    m = wide_pca.fit_wide_pca(scaled.filter(F.col("split") == "train"), 2, "scaledFeatures")
    total, rows = 0.0, []
    for i, v in enumerate(m.explained.tolist()):
        total += v
        rows.append((i + 1, v, total))
    return rounded(spark.createDataFrame(rows, "component int, explained_variance double, cumulative double"))


@query("split_train_test")
def q_split_train_test(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return split.hash_split(o, ["o_orderkey"], (0.8, 0.2), SALT, ("train", "test"))


@query("split_train_val")
def q_split_train_val(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return split.three_way_split(o, ["o_orderkey"], (0.8, 0.2), SALT)


# ------------------------------------------------------------------ metrics

@query("prediction_match")
def q_prediction_match(spark, sf):
    return metrics.prediction_match(lineitem_scored(spark, sf), "prediction", "label",
                                    keep=list(LI_KEYS))


@query("filter_chain")
def q_filter_chain(spark, sf):
    s = lineitem_scored(spark, sf)
    # false positives: predicted 1 and not (label = prediction)
    fp = metrics.filter_chain(s, F.col("prediction") == 1.0,
                              negate(F.col("label") == F.col("prediction")))
    return fp.select(*LI_KEYS, "split", "prediction", "label")


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(lineitem_scored(spark, sf), "prediction", "label",
                                    ["split"])


@query("precision_recall")
def q_precision_recall(spark, sf):
    cm = metrics.confusion_matrix(lineitem_scored(spark, sf), "prediction", "label", ["split"])
    return rounded(metrics.precision_recall(cm).select("split", "precision", "recall",
                                                       "accuracy"))


@query("auroc_hard")
def q_auroc_hard(spark, sf):
    return rounded(metrics.auroc_hard(lineitem_scored(spark, sf), "prediction", "label",
                                      ["split"]))


@query("auroc_exact")
def q_auroc_exact(spark, sf):
    return rounded(metrics.auroc_exact(lineitem_scored(spark, sf), "score", "label", ["split"]))


def lineitem_rule_scores(spark, sf) -> DataFrame:
    s = lineitem_scored(spark, sf)
    rows = F.array(*[F.struct(F.lit(n).alias("model"),
                              (F.col(c) > F.lit(t)).cast("double").alias("prediction"))
                     for n, (c, t) in RULES.items()])
    return s.select("split", "label", F.inline(rows))


@query("model_leaderboard")
def q_model_leaderboard(spark, sf):
    return rounded(metrics.leaderboard(lineitem_rule_scores(spark, sf), "model",
                                       "prediction", "label", "split", "test"))


# ------------------------------------------------------------------ features

@query("assemble_features")
def q_assemble_features(spark, sf):
    c = customer_with_nulls(spark, sf)
    v = features.assemble(c, ["c_nationkey", "c_acctbal"], "features", handle_invalid="skip")
    return rounded(features.vector_to_columns(v, "features", ["x_0", "x_1"],
                                              keep=["c_custkey", "c_name"]))


@query("vector_to_array")
def q_vector_to_array(spark, sf):
    v = features.assemble(lineitem(spark, sf), LI_FEATURES, "features")
    arr = features.vector_to_array("features")
    # every item, as whole hundredths (the measures have two decimals)
    items = F.array_join(F.transform(arr, lambda x: F.round(x * 100).cast("bigint").cast("string")), ",")
    return rounded(v.select(*LI_KEYS, F.size(arr).alias("n_dims"),
                            F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("x_sum"),
                            items.alias("x_hundredths")))


@query("array_to_columns")
def q_array_to_columns(spark, sf):
    v = features.assemble(lineitem(spark, sf), LI_FEATURES, "features")
    v = v.withColumn("arr", features.vector_to_array("features"))
    return rounded(features.array_to_columns(v, "arr", [f"x_{i}" for i in range(len(LI_FEATURES))],
                                             keep=list(LI_KEYS)))


def _scaled_names():
    return [f"{c}_scaled" for c in LI_FEATURES]


@query("standard_scale")
def q_standard_scale(spark, sf):
    # the default feature list: every column but those named
    others = [c for c in lineitem(spark, sf).columns if c not in LI_FEATURES]
    v = features.assemble(lineitem(spark, sf), output_col="features", exclude=others)
    m = features.fit_standard_scaler(v, "features", "scaledFeatures")
    return rounded(features.vector_to_columns(m.transform(v), "scaledFeatures", _scaled_names(),
                                              keep=list(LI_KEYS)))


@query("feature_pipeline")
def q_feature_pipeline(spark, sf):
    s = split.three_way_split(lineitem(spark, sf), LI_KEYS, salt=SALT)
    pm = features.fit_pipeline(s.filter(F.col("split") == "train"), LI_FEATURES)
    return rounded(features.vector_to_columns(pm.transform(s), "scaledFeatures", _scaled_names(),
                                              keep=[*LI_KEYS, "split"]))


# Two strongly correlated measures (the raw lineitem measures are mutually
# uncorrelated, which leaves a 2-column PCA ill-conditioned).
PCA_COLS = ("l_extendedprice", "disc_price")


_PCA_FITS: dict[tuple, tuple] = {}


def _pca_fitted(spark, sf):
    """Scaled rows (lazy) and the PCA fitted on their training part; the fit
    is kept per session and state of the table, so the PCA keys share it."""
    key = model_data.table_state(spark, sf, ("lineitem",))
    if key not in _PCA_FITS:
        _PCA_FITS[key] = _pca_fit(spark, sf)
    return _PCA_FITS[key]


def _pca_fit(spark, sf):
    li = lineitem(spark, sf).withColumn(
        "disc_price", F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))
    s = split.three_way_split(li, LI_KEYS, salt=SALT)
    s = profile.encode_label(s, LI_LABEL, POSITIVE_CLASS, out="label")
    pm = features.fit_pipeline(s.filter(F.col("split") == "train"), PCA_COLS)
    scaled = pm.transform(s)
    # the fit passes over the training vectors more than once
    train = scaled.filter(F.col("split") == "train").select("scaledFeatures").persist()
    pca = features.fit_pca(train, 2)
    train.unpersist()
    return scaled, pca


@query("pca_project")
def q_pca_project(spark, sf):
    scaled, pca = _pca_fitted(spark, sf)
    return rounded(features.pca_table(scaled, pca, keep=[*LI_KEYS, "split"]))


@query("pca_table")
def q_pca_table(spark, sf):
    scaled, pca = _pca_fitted(spark, sf)
    return rounded(features.pca_table(scaled.filter(F.col("split") == "train"), pca,
                                      keep=["label"]))


@query("pca_explained")
def q_pca_explained(spark, sf):
    _, pca = _pca_fitted(spark, sf)
    return rounded(features.pca_explained(pca, spark))


# ------------------------------------------------------------------ models

def _clf(name):
    def q(spark, sf):
        m = model_data.fitted(spark, sf, name)
        return rounded(models.score_splits({name: m}, model_data.prepared(spark, sf),
                                           ["doc_id"]))
    q.__name__ = f"q_clf_{name}"
    return q


for _n in models.MODEL_NAMES:
    query(f"clf_{_n}")(_clf(_n))


def _all_scores(spark, sf) -> DataFrame:
    ms = {n: model_data.fitted(spark, sf, n) for n in models.MODEL_NAMES}
    return models.score_splits(ms, model_data.prepared(spark, sf), ["doc_id"])


@query("score_splits")
def q_score_splits(spark, sf):
    return rounded(_all_scores(spark, sf))


@query("model_features")
def q_model_features(spark, sf):
    """What every model is fitted on: the text features, raw and scaled."""
    names = model_data.TEXT_FEATURES
    scaled = features.vector_to_array("scaledFeatures")
    return rounded(model_data.prepared(spark, sf).select(
        "doc_id", "split", "label", *names, *[scaled.getItem(i).alias(f"{n}_scaled") for i, n in enumerate(names)]))


@query("score_rows")
def q_score_rows(spark, sf):
    return _all_scores(spark, sf).select("model", "split", "doc_id", F.col("label").cast("int").alias("label"))


@query("score_consistency")
def q_score_consistency(spark, sf):
    """Per model and split: rows, positive labels, and broken rules (a score out of
    its range, a prediction that does not follow from the score, a wrong ``equal``)."""
    s, svc = _all_scores(spark, sf), F.col("model") == "linear_svc"
    cut = F.when(svc, F.lit(0.0)).otherwise(F.lit(0.5))
    in_range = F.when(svc, ~F.isnan("score")).otherwise((F.col("score") >= 0) & (F.col("score") <= 1))
    # a score on the cut may go either way
    follows = (F.abs(F.col("score") - cut) < 1e-12) | ((F.col("score") > cut) == (F.col("prediction") == 1.0))
    equal = (F.col("prediction") == F.col("label")).cast("int") == F.col("equal")
    broken = {"bad_score": in_range, "bad_prediction": follows, "bad_equal": equal}
    return s.groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_positive"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in broken.items()])


@query("logistic_optimum")
def q_logistic_optimum(spark, sf):
    """The mean gradient (p - y) x of the fitted logistic regression over its training
    rows, per scaled measure and intercept: zero at the optimum."""
    s = profile.encode_label(split.three_way_split(lineitem(spark, sf), LI_KEYS, salt=SALT),
                             LI_LABEL, POSITIVE_CLASS, out="label")
    train = s.filter(F.col("split") == "train")
    rows = features.fit_pipeline(train, LI_FEATURES).transform(train).select("label", "scaledFeatures") \
        .persist()
    try:
        m = models.fit_models(rows, ["logistic"])["logistic"]
        x, p = features.vector_to_array("scaledFeatures"), features.vector_to_array("probability").getItem(1)
        off = p - F.col("label")
        terms = [F.lit(1.0), *[x.getItem(i) for i in range(len(LI_FEATURES))]]
        got = m.transform(rows).agg(*[F.avg(off * t).alias(f"g{i}") for i, t in enumerate(terms)]).first()
    finally:
        rows.unpersist()
    return spark.createDataFrame(
        [(n, round(got[i], 4) + 0.0) for i, n in enumerate(("intercept", *LI_FEATURES))],
        "term string, mean_gradient double")


@query("clf_leaderboard")
def q_clf_leaderboard(spark, sf):
    return rounded(metrics.leaderboard(_all_scores(spark, sf), "model", "prediction", "label",
                                       "split", "test", order=models.MODEL_NAMES))


# ------------------------------------------------------------------ tree audits

TREE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
TREE_DEPTH = 4
CUT_RULE = 2.0


def _tree_rows(spark, sf) -> DataFrame:
    """Measures of few values (each its own bin) and a label that depends on three of them."""
    cut = F.col("l_quantity") * (F.col("l_discount") + F.col("l_tax"))
    li = lineitem(spark, sf).withColumn("label", (cut > CUT_RULE).cast("double"))
    return features.assemble(li, TREE_FEATURES).select("label", "features")


def _splits(nodes: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(c) for c in TREE_FEATURES]), F.col("feature") + 1)
    return rounded(nodes.filter("feature >= 0").select(
        "path", name.alias("feature"), "cut", "n", "gain"))


@query("boost_leaves")
def q_boost_leaves(spark, sf):
    """The leaves of the one-round booster: rows, gradient, hessian and weight of each."""
    m = models.estimator("boosted_one_round", features_col="features").fit(_tree_rows(spark, sf))
    return rounded(m.nodes(spark).filter("feature < 0").select("path", "n", "g", "h", F.col("value").alias("weight")))


@query("boost_splits")
def q_boost_splits(spark, sf):
    """The splits of the first tree of the many-round booster, grown best leaf first."""
    m = models.estimator("boosted_many_rounds", features_col="features", rounds=1, leaves=8, from_mean=False)
    return _splits(m.fit(_tree_rows(spark, sf)).nodes(spark))


@query("forest_splits")
def q_forest_splits(spark, sf):
    """The splits of a random-forest tree fitted on all rows and all features, whose rows
    are routed through it again: rows and Gini gain of each node."""
    rows = _tree_rows(spark, sf)
    m = models.estimator("random_forest", features_col="features", numTrees=1, bootstrap=False,
                         featureSubsetStrategy="all", maxDepth=TREE_DEPTH, maxBins=64).fit(rows)
    return _splits(trees.audit(rows, m.trees[0], "features", "label"))


@query("svc_optimum")
def q_svc_optimum(spark, sf):
    """Per scaled feature and the intercept: training rows, and whether the hinge
    subgradient interval of the fitted SVC holds zero."""
    train = model_data.prepared(spark, sf).filter(F.col("split") == "train")
    m = model_data.fitted(spark, sf, "linear_svc")
    got = models.hinge_interval(train, m.coefficients.toArray().tolist(), m.intercept, "scaledFeatures", "label",
                                model_data.TEXT_FEATURES)
    return got.select("term", "n", ((F.col("low") <= 0) & (F.col("high") >= 0)).alias("holds_zero"))

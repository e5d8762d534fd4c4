"""Second-order boosting against a plain numpy version, and the audits of fitted trees."""

import math
import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from cohortlab.operators import boosting, features, models, trees
from cohortlab.plans import model_data
from cohortlab.plans import queries as Q
from tests.conftest import SF001, SF0001


def _plain_fit(x, y, cuts, s):
    """The same method row by row: masks instead of histograms, one split after another."""
    p0 = y.mean()
    margin = np.full(len(y), math.log(p0 / (1 - p0)) if s.from_mean and 0 < p0 < 1 else 0.0)
    out = []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = {1: np.ones(len(y), bool)}
        splits = {}
        while len(leaves) < (s.leaves or 1 << 30):
            best = None
            for path, m in leaves.items():
                if s.depth is not None and path.bit_length() - 1 >= s.depth:
                    continue
                for f, cs in enumerate(cuts):
                    for c in cs:
                        a = m & (x[:, f] < c)
                        b = m & ~(x[:, f] < c)
                        if min(a.sum(), b.sum()) < max(s.min_rows, 1) or min(h[a].sum(), h[b].sum()) < s.min_hessian:
                            continue
                        gain = (g[a].sum() ** 2 / (h[a].sum() + s.l2) + g[b].sum() ** 2 / (h[b].sum() + s.l2)
                                - g[m].sum() ** 2 / (h[m].sum() + s.l2) - 2 * s.gamma)
                        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = (gain, path, f, c)
            if best is None:
                break
            gain, path, f, c = best
            m = leaves.pop(path)
            splits[path] = (f, c, gain)
            leaves[2 * path], leaves[2 * path + 1] = m & (x[:, f] < c), m & ~(x[:, f] < c)
        if not splits:
            break
        for m in leaves.values():
            margin[m] -= s.step * g[m].sum() / (h[m].sum() + s.l2)
        out.append(splits)
    return out, margin


def _frame(spark, x, y, parts):
    rows = [(i, float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, label double, " + ", ".join(f"f{i} double" for i in range(x.shape[1])))
    return features.assemble(df.repartition(parts, "id"), [f"f{i}" for i in range(x.shape[1])])


CASES = [dict(rounds=4, step=0.1, leaves=7, min_rows=5),
         dict(rounds=1, step=0.3, leaves=None, depth=4, l2=1.0, min_rows=1, min_hessian=1.0, from_mean=False),
         dict(rounds=2, step=0.5, leaves=None, depth=3, l2=0.5, gamma=0.8, min_rows=2)]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("over_tasks", [False, True])
def test_trees_equal_the_plain_version(spark, monkeypatch, case, over_tasks):
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=300).round(1), rng.integers(0, 9, 300), rng.normal(size=300).round(2)], axis=1)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=300) > 1).astype(float)
    if over_tasks:
        monkeypatch.setattr(boosting, "rebalance", lambda df: df.repartition(5))
        monkeypatch.setattr(boosting, "CUT_ROUNDS", 2)
    m = boosting.BoostedTreesClassifier("label", "features", bins=30, **case).fit(_frame(spark, x, y, 3))
    want, margin = _plain_fit(x, y, m.cuts, m.settings)
    got = [{r["path"]: (r["feature"], r["cut"], r["gain"]) for r in m.nodes(spark).collect()
            if r["tree"] == t and r["feature"] >= 0} for t in range(len(m.trees))]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a.keys() == b.keys()
        for k in a:
            assert a[k][:2] == b[k][:2] and math.isclose(a[k][2], b[k][2], rel_tol=1e-6)
    scored = {r.id: r.margin for r in m.transform(_frame(spark, x, y, 3)).collect()}
    assert np.allclose([scored[i] for i in range(300)], margin)


def test_blocks_of_features_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)).round(1)
    df = _frame(spark, x, (x[:, 1] * x[:, 2] > 0).astype(float), 2)
    fit = lambda: boosting.BoostedTreesClassifier("label", "features", rounds=2, leaves=6, min_rows=3, bins=20).fit(df)
    whole = fit()
    monkeypatch.setattr(boosting, "HISTOGRAM_BYTES", 1)
    parts = fit()
    assert [[(n.feature, n.bin) for n in t] for t in whole.trees] == [[(n.feature, n.bin) for n in t] for t in parts.trees]


def test_no_histogram_reaches_the_driver(spark, monkeypatch):
    sent, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(boosting, "rebalance", lambda df: df.repartition(5))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    m = boosting.BoostedTreesClassifier("label", "features", rounds=2, leaves=8, min_rows=3).fit(
        _frame(spark, x, (x[:, 1] * x[:, 2] > 0).astype(float), 2))
    assert len(m.trees) == 2 and min(map(len, m.cuts)) > 200
    # a histogram of one leaf takes 18 kB
    assert sent and max(len(pickle.dumps(part)) for part in sent) < 10_000


def test_a_pass_sends_one_split_a_leaf(spark, monkeypatch):
    sent, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(boosting, "rebalance", lambda df: df.repartition(5))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6)).round(1)
    df = _frame(spark, x, (x[:, 1] * x[:, 4] > 0).astype(float), 2)
    fit = lambda: boosting.BoostedTreesClassifier("label", "features", rounds=2, leaves=8, min_rows=3).fit(df)
    one = fit()
    assert sent and max(map(len, sent)) == 1                   # from one task, over all features
    sent.clear()
    monkeypatch.setattr(boosting, "ADDED_BYTES", 1)
    many = fit()
    assert max(map(len, sent)) == 5                            # as many as the blocks have tasks
    assert [[(n.feature, n.bin, n.n) for n in t] for t in one.trees] == [[(n.feature, n.bin, n.n) for n in t] for t in many.trees]


def test_rows_of_a_short_pass_lie_in_one_task(spark):
    rows = lambda n, dim: spark.range(n).select(F.lit(0.0).alias("_y"), *[F.lit(1).alias(f"_b{i}") for i in range(dim)])
    parts = lambda n, dim: boosting.rebalance(rows(n, dim)).rdd.getNumPartitions()
    assert parts(128_000, 8) == 1
    cores = spark.sparkContext.defaultParallelism
    assert parts(600_000, 8) == min(cores, 3) and parts(100_000, 40) == min(cores, 2)


def test_odd_frames(spark):
    fit = lambda rows, **kw: boosting.BoostedTreesClassifier(
        "label", "features", **{"rounds": 3, "min_rows": 1, **kw}).fit(
        features.assemble(spark.createDataFrame(rows, "label double, a double, b double"), ["a", "b"], handle_invalid="keep"))
    assert fit([]).trees == []
    assert fit([(1.0, 1.0, 2.0)] * 5).trees == []                             # one class, one value
    one = fit([(1.0, 1.0, 2.0)] * 5 + [(0.0, 3.0, 2.0)] * 5 + [(None, 9.0, 9.0)])
    assert one.trees[0][0].feature == 0 and one.trees[0][0].cut == 2.0 and one.trees[0][0].n == 10
    nan = fit([(1.0, float("nan"), 0.0)] * 6 + [(0.0, float(i % 3), 0.0) for i in range(6)], rounds=1)
    got = nan.transform(features.assemble(spark.createDataFrame([(float("nan"), 0.0), (2.0, 0.0)], "a double, b double"),
                                          ["a", "b"], handle_invalid="keep")).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
    again = boosting.BoostedTreesModel.from_json(one.to_json())
    assert again.to_json() == one.to_json() and again.settings == one.settings


def test_many_bins_fall_back_to_quantiles(spark):
    df = spark.range(5000).select((F.col("id") / 7).alias("v"), F.lit(1.0).alias("w"))
    cuts = boosting.cut_points(df, ["v", "w"], 16)
    assert len(cuts[0]) == 15 and cuts[1] == [] and cuts[0] == sorted(cuts[0])


def test_many_rounds_hold_out(spark):
    """Held-out ranking not below that of the level-wise booster of Spark."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from cohortlab.operators import metrics
    d = model_data.prepared(spark, SF001).withColumn("label", F.col("label").cast("double"))
    other = GBTClassifier(featuresCol="scaledFeatures", maxIter=10, maxDepth=5).fit(d.filter("split = 'train'"))
    base = BinaryClassificationEvaluator().evaluate(other.transform(d.filter("split = 'test'")))
    m = model_data.fitted(spark, SF001, "boosted_many_rounds")
    s = models.score_splits({"m": m}, d.filter("split = 'test'"), ["doc_id"])
    assert metrics.auroc_exact(s, "score", group_cols=["model"]).first().auroc >= base - 1e-9


def test_forest_audit_counts_rows(spark):
    rows = Q._tree_rows(spark, SF0001)
    m = models.estimator("random_forest", features_col="features", numTrees=1, bootstrap=False,
                         featureSubsetStrategy="all", maxDepth=3, maxBins=64).fit(rows)
    nodes = {r.path: r for r in trees.audit(rows, m.trees[0], "features", "label").collect()}
    assert nodes[1].n == rows.count() and len(nodes) == m.trees[0].numNodes
    for p, r in nodes.items():
        if r.feature >= 0:
            assert r.n == nodes[2 * p].n + nodes[2 * p + 1].n and r.gain > 0


def test_svc_optimum_sees_wrong_weights(spark):
    good = Q.q_svc_optimum(spark, SF001).collect()
    assert len(good) == 9 and all(r.holds_zero for r in good)
    train = model_data.prepared(spark, SF001).filter(F.col("split") == "train")
    m = model_data.fitted(spark, SF001, "linear_svc")
    w = m.coefficients.toArray()
    for off in (w * 0.8, w + np.eye(len(w))[2], -w):
        got = models.hinge_interval(train, off.tolist(), m.intercept, "scaledFeatures", "label", model_data.TEXT_FEATURES)
        assert got.filter("low > 0 OR high < 0").count() > 0

"""Randomised subspace iteration against Spark's PCA and on frames it refuses."""

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlab.operators import features, wide_pca
from cohortlab.plans import queries as Q
from tests.conftest import SF001


def _signed(pc):
    first = np.argmax(np.abs(pc) > 1e-6, axis=0)
    return pc * np.where(pc[first, np.arange(pc.shape[1])] < 0, -1.0, 1.0)


def test_equals_spark_pca_on_lineitem(spark):
    x = features.assemble(Q.lineitem(spark, SF001), Q.LI_FEATURES).select("l_orderkey", "features")
    own = wide_pca.fit_wide_pca(x, 2, "features")
    other = PCA(k=2, inputCol="features", outputCol="p").fit(x)
    assert np.abs(own.components - _signed(other.pc.toArray())).max() < 1e-6
    assert np.abs(own.explained - other.explainedVariance.toArray()).max() < 1e-6
    got = wide_pca.project(x.limit(20), own, "features")
    assert got.columns == ["l_orderkey", "PCA_1", "PCA_2"] and got.count() == 20


def test_equals_numpy_on_embeddings(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    from pyspark.ml.functions import array_to_vector
    x = emb.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")).repartition(7)
    m = np.array([r.v.toArray() for r in x.collect()])
    own = wide_pca.fit_wide_pca(x, 3, "v", tolerance=1e-15, most_passes=300)
    w, v = np.linalg.eigh(np.cov(m.T))
    assert np.allclose(own.variances, w[::-1][:3], rtol=1e-6)
    assert np.abs(own.components - _signed(v[:, ::-1][:, :3])).max() < 1e-4
    assert np.allclose(own.explained, w[::-1][:3] / w.sum(), rtol=1e-6)


def test_sparse_frame_wider_than_sparks_limit(spark):
    d, rng = 200_000, np.random.default_rng(6)
    strong = np.sort(rng.choice(d, 40, replace=False))
    rows = []
    for i in range(400):
        a, b = rng.normal(), rng.normal()
        idx = np.unique(np.concatenate([strong, rng.integers(0, d, 20)]))
        val = np.where(np.isin(idx, strong[:20]), 5 * a, np.where(np.isin(idx, strong[20:]), 3 * b, 0.1))
        rows.append((i, Vectors.sparse(d, idx.tolist(), val.tolist())))
    x = spark.createDataFrame(rows, ["id", "v"]).repartition(5)
    with pytest.raises(ValueError):
        features.fit_pca(x, 2, "v", "p")
    own = wide_pca.fit_wide_pca(x, 2, "v")
    assert own.components.shape == (d, 2) and own.explained.sum() > 0.95
    assert np.abs(own.components[strong[:20], 0]).min() > 0.2 and np.abs(own.components[strong[20:], 1]).min() > 0.2
    got = wide_pca.project(x, own, "v").agg(F.variance("PCA_1").alias("a"), F.variance("PCA_2").alias("b")).first()
    assert np.allclose([got.a, got.b], own.variances, rtol=1e-6)


def test_odd_frames(spark):
    x = \
        spark.createDataFrame([(1, Vectors.dense([1.0, 2.0])), (2, Vectors.dense([1.0, 2.0]))], ["id", "v"])
    own = wide_pca.fit_wide_pca(x, 1, "v")
    assert own.variances.tolist() == [0.0] and own.explained.tolist() == [0.0]
    assert wide_pca.fit_wide_pca(x.limit(1), 1, "v").passes == 0
    assert wide_pca.fit_wide_pca(x.limit(0), 1, "v").components.shape[0] == 0
    empty = spark.createDataFrame([(i, Vectors.sparse(4, [i % 3], [1.0]) if i else Vectors.sparse(4, [], [])) for i in range(9)],
                                  ["id", "v"])
    assert wide_pca.fit_wide_pca(empty, 2, "v").explained.sum() <= 1 + 1e-9

"""Model tests: quality floor on a learnable label, and a leak
detector on a label that is independent of the features."""

from pyspark.sql import functions as F

from cohortlab.operators import features, metrics, models, split
from cohortlab.plans import queries as Q
from tests.conftest import SF001, SF01


def test_every_model_learns_document_quality(spark):
    board = {r.model: r.auroc for r in Q.q_clf_leaderboard(spark, SF01).collect()}
    assert set(board) == set(models.MODEL_NAMES)
    assert all(v > 0.90 for v in board.values()), board


def test_score_table_shape(spark):
    scored = Q.q_score_splits(spark, SF001)
    assert scored.columns == ["model", "split", "doc_id", "label", "prediction", "score", "equal"]
    per = {(r.model, r.split) for r in scored.select("model", "split").distinct().collect()}
    assert len(per) == 15


def test_no_leak_on_random_label(spark):
    li = Q.lineitem(spark, SF001).withColumn(
        "label", (F.col("l_returnflag") == "R").cast("int"))
    parts = split.three_way_split(li, Q.LI_KEYS)
    pm = features.fit_pipeline(parts.filter("split = 'train'"), Q.LI_FEATURES)
    prepared = pm.transform(parts).select(*Q.LI_KEYS, "split", "label", "scaledFeatures").persist()
    ms = models.fit_models(prepared.filter("split = 'train'"), models.MODEL_NAMES)
    scored = models.score_splits(ms, prepared, list(Q.LI_KEYS))
    exact = metrics.auroc_exact(scored.filter("split = 'test'"), "score", group_cols=["model"])
    for r in exact.collect():
        assert abs(r.auroc - 0.5) < 0.03, (r.model, r.auroc)
    prepared.unpersist()


def test_fits_run_on_several_partitions(spark):
    from cohortlab.plans import model_data
    model_data.clear()
    train = model_data.prepared(spark, SF001, rows_per_partition=50).filter("split = 'train'")
    sizes = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4
    fitted = models.fit_models(train, models.MODEL_NAMES)
    assert set(fitted) == set(models.MODEL_NAMES)
    model_data.clear()
    assert not model_data._PREPARED and not model_data._FITTED


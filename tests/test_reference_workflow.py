"""The reference's whole workflow, end to end, on a table of its shape."""

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import features, metrics, models, profile, split
from cohortlab.operators.profile import RADAR_ORDER
from cohortlab.sources import read_csv, view_sql, write_csv
from tests.fixtures import FEATURES, cancer_like


@pytest.fixture(scope="module")
def table(spark):
    path = write_csv(cancer_like(spark))
    df = read_csv(spark, path, header=True, infer_schema=True)
    return df.cache()


def test_csv_inference_types(table):
    types = dict(table.dtypes)
    assert types["id"] == "int" and types["diagnosis"] == "string"
    assert all(types[c] == "double" for c in FEATURES)
    assert table.count() == 569


def test_null_filter_and_describe(table):
    summary = profile.describe_table(profile.drop_null_heavy_rows(table))
    rows = {r.summary: r for r in summary.collect()}
    assert set(rows) == {"count", "mean", "stddev", "min", "max"}
    assert rows["count"]["radius_mean"] == "569"
    assert rows["mean"]["diagnosis"] is None   # string column: no mean
    long = {r.attribute: r for r in profile.describe_long(table, FEATURES).collect()}
    assert long["radius_mean"].n == 569


def test_encode_families_subsets(spark, table):
    enc = profile.encode_label(table, "diagnosis", "M", out="Int_Diagnostics")
    assert enc.agg(F.sum("Int_Diagnostics")).first()[0] == 212
    assert len(profile.project_family(enc, "_mean", lead=("diagnosis",)).columns) == 11
    assert len(profile.project_family(enc, "_se").columns) == 10
    assert len(profile.project_family(enc, "_worst").columns) == 10
    benign = profile.class_subset(enc, "diagnosis", "B")
    malignant = profile.class_subset(enc, "diagnosis", "M")
    assert benign.count() == 357 and malignant.count() == 212
    some_id = benign.select("id").orderBy("id").first().id
    one = view_sql(spark, "SELECT radius_mean FROM Non_Cancer_Data WHERE id = :k",
                   views={"Non_Cancer_Data": benign}, args={"k": some_id})
    assert one.count() == 1


def test_profiles_and_radar(spark, table):
    cols = [f"{m}_{f}" for f in ("mean", "worst") for m in RADAR_ORDER]
    st = profile.class_stats(table, "diagnosis", cols)
    b_id = table.filter("diagnosis = 'B'").agg(F.min("id")).first()[0]
    m_id = table.filter("diagnosis = 'M'").agg(F.min("id")).first()[0]
    keys = spark.createDataFrame([(b_id, "B"), (m_id, "M")], "id int, diagnosis string")
    rec = profile.record_profile(table, "id", "diagnosis", cols, keys, stats=st)
    got = rec.collect()
    assert len(got) == 40 and all(0.0 <= r.scaled <= 1.0 for r in got)
    base = profile.baseline_profile(st, "diagnosis")
    assert all(0.0 < r.scaled_avg < 1.0 for r in base.filter("diagnosis = 'B'").collect())
    fam = {f: [f"{m}_{f}" for m in RADAR_ORDER] for f in ("worst", "mean")}
    radar = profile.radar_table(base, rec, "diagnosis", fam, "B", ["B", "M"]).collect()
    assert len(radar) == 20
    first = [r for r in radar if r.family == "worst" and r.pos == 1][0]
    assert first.attribute == "fractal_dimension_worst"
    assert all(r.baseline is not None and r.record_B is not None for r in radar)
    # lookup by the key with expect_one
    assert profile.point_lookup(table, "id", b_id, expect_one=True).count() == 1


def test_prepare_train_score(spark, table):
    enc = profile.encode_label(table, "diagnosis", "M", out="Int_Diagnostics")
    feats = profile.feature_columns(enc, ["id", "diagnosis", "Int_Diagnostics"])
    assert tuple(feats) == FEATURES
    parts = split.three_way_split(enc, ["id"])
    train = parts.filter("split = 'train'")
    pm = features.fit_pipeline(train, feats, features_col="Resultfeatures")
    prepared = pm.transform(parts).persist()
    pca = features.fit_pca(prepared.filter("split = 'train'"), 2)
    pt = features.pca_table(prepared.filter("split = 'train'"), pca, keep=["Int_Diagnostics"])
    assert pt.columns == ["Int_Diagnostics", "PCA_1", "PCA_2"]
    ms = models.fit_models(prepared.filter("split = 'train'"), label_col="Int_Diagnostics")
    scored = models.score_splits(ms, prepared, ["id"], label_col="Int_Diagnostics")
    board = {r.model: r for r in
             metrics.leaderboard(scored, order=models.MODEL_NAMES).collect()}
    assert {m: r.pos for m, r in board.items()} == {
        "boosted_one_round": 1, "random_forest": 2, "linear_svc": 3, "logistic": 4, "boosted_many_rounds": 5}
    assert set(board) == set(models.MODEL_NAMES)
    assert all(r.auroc > 0.9 for r in board.values()), board
    cm = metrics.confusion_matrix(scored, group_cols=["model", "split"]).collect()
    assert len(cm) == 15 and all(r.tp + r.fp + r.tn + r.fn == r.n for r in cm)
    exact = metrics.auroc_exact(scored, "score", group_cols=["model", "split"]).collect()
    assert all(r.auroc > 0.9 for r in exact if r.split == "test")
    prepared.unpersist()


def test_notebook_flow_one_call(spark, table):
    from cohortlab.workflow import notebook_flow, release
    b_id = table.filter("diagnosis = 'B'").agg(F.min("id")).first()[0]
    m_id = table.filter("diagnosis = 'M'").agg(F.max("id")).first()[0]
    out = notebook_flow(table, record_ids={"B": b_id, "M": m_id}, label_out="Int_Diagnostics")
    assert out["summary"].count() == 5
    assert out["radar"].count() == 20
    assert {r.id for r in out["record_profile"].collect()} == {b_id, m_id}
    assert out["pca_table"].columns == ["Int_Diagnostics", "PCA_1", "PCA_2"]
    board = out["leaderboard"].collect()
    assert len(board) == 5 and all(r.auroc > 0.9 for r in board)
    assert out["metrics"].count() == 15 and out["auroc_exact"].count() == 15
    release(out)
    assert not out["prepared"].storageLevel.useMemory and not out["scored"].storageLevel.useMemory

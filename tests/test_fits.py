"""Fits kept in the shared folder: read by a later session, refitted for a rewritten table."""

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import models
from cohortlab.plans import model_data
from cohortlab.sources import fits
from tests.conftest import SF0001

NAMES = ("boosted_one_round", "random_forest", "logistic")


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF0001}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/sf/{t}.parquet")
    monkeypatch.setattr(fits, "base_dir", lambda s: f"{tmp_path}/fits")
    model_data.clear()
    yield tmp_path
    model_data.clear()


def _scores(spark, sf):
    ms = {n: model_data.fitted(spark, sf, n) for n in NAMES}
    got = models.score_splits(ms, model_data.prepared(spark, sf), ["doc_id"])
    return sorted((r.model, r.doc_id, r.score, r.prediction) for r in got.collect())


def test_later_session_reads_and_rewritten_table_refits(spark, folder, monkeypatch):
    sf = f"{folder}/sf"
    first = _scores(spark, sf)
    model_data.clear()                                    # what a new session starts with
    with monkeypatch.context() as m:
        m.setattr(models, "fit_models", lambda *a, **k: pytest.fail("fitted again"))
        m.setattr(model_data.features, "fit_pipeline", lambda *a, **k: pytest.fail("fitted again"))
        assert _scores(spark, sf) == first
    places = {p.parent.name: p.name for p in (folder / "fits").glob("*/*/*")}
    assert set(places) == {"pipeline", *NAMES}
    (spark.read.parquet(f"{SF0001}/documents.parquet").filter(F.col("doc_id") % 7 != 0).coalesce(1)
     .write.mode("overwrite").parquet(f"{sf}/documents.parquet"))
    model_data.clear()
    assert len(_scores(spark, sf)) < len(first)
    after = [(p.parent.name, p.name) for p in (folder / "fits").glob("*/*/*")]
    assert len(after) == len(places) and all(places[n] != key for n, key in after)


def test_a_lost_fit_leaves_nothing_and_is_made_again(spark, tmp_path):
    def half(model, path):
        spark.createDataFrame([("x",)], "value string").write.text(path)
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        fits.kept(spark, "slot", 1, lambda: "m", half, lambda p: p, str(tmp_path))
    calls = []
    save = lambda m, path: spark.createDataFrame([(m,)], "value string").write.text(path)
    load = lambda path: spark.read.text(path).first()[0]
    for _ in range(2):
        assert fits.kept(spark, "slot", 1, lambda: calls.append(1) or "model", save, load, str(tmp_path)) == "model"
    assert len(calls) == 1

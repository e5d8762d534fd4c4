"""Text statistics of documents: values by plain Python, and work dealt over the cores."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlab.plans import model_data

TEXTS = [None, "", "   ", "a", " A a\tb ", "\n x", "x \n", "İi I ı", "Ünder-Way, 12!", "a\u00a0b a", "\t", "q " * 40]


def _plain(text):
    t = text or ""
    words = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ")) if t.strip(" ") else []
    return len(t), len(words), len({w.lower() for w in words})


def test_values_equal_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in model_data.text_features(docs).collect():
        n, w, d = _plain(TEXTS[r.doc_id])
        assert (r.n_chars, r.n_words, r.n_distinct) == (n, w, d)
        assert r.type_token_ratio == (d / w if w else 0.0)
        solid = len(re.sub(r"[ \t\n\x0b\f\r]+", "", TEXTS[r.doc_id] or ""))
        assert r.mean_word_len == pytest.approx(solid / w if w else 0.0)


def test_one_row_group_is_dealt_over_the_cores(spark, tmp_path, monkeypatch):
    """One task reads a row group; the text work behind it uses all cores, with the same rows."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("Some words"), "id").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    (rows.filter("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality")).coalesce(1)
     .write.parquet(f"{tmp_path}/labels.parquet"))
    tasks = []
    plain = model_data.text_features
    monkeypatch.setattr(model_data, "text_features", lambda d: tasks.append(
        d.groupBy(F.spark_partition_id()).count().count()) or plain(d))
    few = model_data.labelled(spark, str(tmp_path)).collect()
    monkeypatch.setattr(model_data.spread, "__defaults__", (100,))
    many = model_data.labelled(spark, str(tmp_path)).collect()
    assert sorted(few) == sorted(many) and len(many) == 2000
    assert tasks[0] == 1 and tasks[1] >= spark.sparkContext.defaultParallelism

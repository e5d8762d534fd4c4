"""The confusion counts over a streaming read equal the batch result."""

from pyspark.sql import functions as F

from cohortlab.functions.columns import encode_binary
from cohortlab.operators import metrics, split
from cohortlab.plans import queries as Q
from cohortlab.streaming import read_parquet_stream, running_confusion, start
from tests.conftest import SF001


def _prepare(df):
    df = df.withColumn("label", encode_binary("l_returnflag", "R"))
    df = df.withColumn("prediction", (F.col("l_extendedprice") > 30000.0).cast("double"))
    return split.three_way_split(df, Q.LI_KEYS)


def test_streaming_confusion_equals_batch(spark):
    batch = spark.read.parquet(f"{SF001}/lineitem.parquet")
    stream = read_parquet_stream(spark, SF001, batch.schema, glob="lineitem.parquet")
    counts = running_confusion(_prepare(stream), group_cols=["split"])
    q = start(counts, "cohort_confusion", "memory", output_mode="complete")
    try:
        q.processAllAvailable()
        got = {r.split: tuple(r[1:]) for r in spark.sql("SELECT * FROM cohort_confusion").collect()}
    finally:
        q.stop()
    want = {r.split: tuple(r[1:]) for r in
            metrics.confusion_matrix(_prepare(batch), group_cols=["split"]).collect()}
    assert got == want


def test_streaming_class_profile_equals_batch(spark):
    from cohortlab.operators import profile
    batch = spark.read.parquet(f"{SF001}/lineitem.parquet")
    stream = read_parquet_stream(spark, SF001, batch.schema, glob="lineitem.parquet")
    prof = profile.class_profile(stream, "l_returnflag", Q.LI_FEATURES)
    q = start(prof, "cohort_profile", "memory", output_mode="complete")
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM cohort_profile").collect())
    finally:
        q.stop()
    want = sorted(tuple(r) for r in
                  profile.class_profile(batch, "l_returnflag", Q.LI_FEATURES).collect())
    assert len(got) == len(want) == 12
    for g, w in zip(got, want):
        assert g[:3] == w[:3]
        assert all(abs(a - b) < 1e-9 * max(1.0, abs(b)) for a, b in zip(g[3:], w[3:]))


def test_score_stream_equals_batch_scores(spark):
    from cohortlab.operators import split as split_ops
    from cohortlab.plans import model_data
    from cohortlab.streaming import score_stream
    from tests.conftest import SF0001
    fitted = {"logistic": model_data.fitted(spark, SF0001, "logistic")}
    pm = model_data.feature_model(spark, SF0001)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    labels = spark.read.parquet(f"{SF0001}/labels.parquet").select(
        "doc_id", F.col("quality").alias("label"))
    stream = read_parquet_stream(spark, SF0001, docs.schema, glob="documents.parquet")
    feats = model_data.text_features(stream).join(labels, "doc_id")   # stream-static join
    prepared = pm.transform(split_ops.three_way_split(feats, ["doc_id"], salt=model_data.SALT))
    scored = score_stream(fitted, prepared, ["doc_id"], split_col="split")
    q = start(scored.select("model", "split", "doc_id", "prediction", "equal"), "cohort_scores", "memory",
              output_mode="append")
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM cohort_scores").collect())
    finally:
        q.stop()
    from cohortlab.operators import models
    batch = models.score_splits(fitted, model_data.prepared(spark, SF0001), ["doc_id"])
    want = sorted(tuple(r) for r in batch.select("model", "split", "doc_id", "prediction",
                                                 "equal").collect())
    assert got == want and len(got) > 0


def test_streaming_auroc_equals_batch_after_every_part(spark, tmp_path):
    from cohortlab.streaming import auroc_now, keep_score_counts
    rows = _prepare(spark.read.parquet(f"{SF001}/lineitem.parquet")).select(
        "split", F.col("label").cast("double").alias("label"), F.round("l_extendedprice", -2).alias("score"))
    parts = rows.randomSplit([1.0, 1.0, 1.0], 5)
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("in", "out", "ckpt"))
    for i, p in enumerate(parts):                         # every part by a new query on the old state
        p.coalesce(2).write.mode("append").parquet(src)
        stream = read_parquet_stream(spark, src, rows.schema, max_files_per_trigger=1)
        q = keep_score_counts(stream, out, group_cols=["split"], checkpoint=ckpt, trigger_once=True)
        assert q.awaitTermination(120)
        got = {r.split: r.auroc for r in auroc_now(spark, out, group_cols=["split"]).collect()}
        want = {r.split: r.auroc for r in metrics.auroc_exact(spark.read.parquet(src), "score", group_cols=["split"]).collect()}
        assert got == want and len(got) == 3

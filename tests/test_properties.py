"""Properties checked on the test tables and on random frames."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortlab.operators import align, features, metrics, split
from cohortlab.plans import queries as Q
from tests.conftest import SF001


def test_split_disjoint_complete_layout_free(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey")
    a = split.three_way_split(o, ["o_orderkey"])
    b = split.three_way_split(o.repartition(4, "o_orderkey"), ["o_orderkey"])
    ra = {r.o_orderkey: r.split for r in a.collect()}
    rb = {r.o_orderkey: r.split for r in b.collect()}
    assert ra == rb and len(ra) == o.count()
    n = len(ra)
    share = {s: sum(1 for v in ra.values() if v == s) / n for s in ("train", "val", "test")}
    assert abs(share["test"] - 0.2) < 0.02 and abs(share["val"] - 0.16) < 0.02


def test_split_thresholds():
    assert split.thresholds([0.8, 0.2]) == ["cccccccc"]
    assert split.thresholds([1, 1, 2]) == ["40000000", "80000000"]


def test_confusion_cells_sum(spark):
    cm = Q.q_confusion_matrix(spark, SF001).collect()
    for r in cm:
        assert r.tp + r.fp + r.tn + r.fn == r.n == r.correct + r.wrong


def test_auroc_hard_equals_evaluator(spark):
    s = Q.lineitem_scored(spark, SF001)
    ours = {r.split: r.auroc for r in metrics.auroc_hard(s, group_cols=["split"]).collect()}
    ev = BinaryClassificationEvaluator(rawPredictionCol="prediction", labelCol="label",
                                       metricName="areaUnderROC", numBins=0)
    for name, v in ours.items():
        part = s.filter(F.col("split") == name).withColumn("label", F.col("label").cast("double"))
        assert abs(ev.evaluate(part) - v) < 1e-12


def test_auroc_exact_equals_evaluator(spark):
    s = Q.lineitem_scored(spark, SF001).withColumn("label", F.col("label").cast("double"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                       metricName="areaUnderROC", numBins=0)
    ours = {r.split: r.auroc for r in metrics.auroc_exact(s, "score", group_cols=["split"]).collect()}
    for name, v in ours.items():
        assert abs(ev.evaluate(s.filter(F.col("split") == name)) - v) < 1e-9


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=1, max_size=60),
       st.integers(1, 7))
def test_auroc_exact_brute_force(spark, pairs, ranges):
    df = spark.createDataFrame([(float(s), y) for s, y in pairs], "score double, label int")
    got = metrics.auroc_exact(df, "score", ranges=ranges).first().auroc
    want = _brute_auc(pairs)
    assert (got is None and want is None) or math.isclose(got, want, abs_tol=1e-12)


def test_auroc_exact_hot_score(spark):
    # one score value holds a third of the rows: it collapses to one row first
    rows = [(0.5, i % 2) for i in range(300)] + [(i / 600.0, (i * 7) % 3 % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = metrics.auroc_exact(df, "score", ranges=5).first().auroc
    assert math.isclose(got, _brute_auc(rows), abs_tol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-1000, 1000), min_size=0, max_size=80, unique=True),
       st.integers(1, 9))
def test_row_index_dense(spark, keys, ranges):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r["index"] for r in align.row_index(df, ["k"], ranges=ranges).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_row_index_not_null_long(spark):
    df = spark.createDataFrame([(3,), (1,)], "k long")
    f = align.row_index(df, ["k"]).schema["index"]
    assert f.dataType.typeName() == "long"


def test_min_max_in_unit_range(spark):
    out = Q.q_min_max_scale(spark, SF001)
    cols = [c for c in out.columns if c.endswith("_scaled")]
    agg = out.agg(*[F.min(c).alias(f"lo_{c}") for c in cols],
                  *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    for c in cols:
        assert agg[f"lo_{c}"] == 0.0 and agg[f"hi_{c}"] == 1.0


def test_scaled_train_std_is_one(spark):
    li = Q.lineitem(spark, SF001)
    s = split.three_way_split(li, Q.LI_KEYS)
    train = s.filter("split = 'train'")
    pm = features.fit_pipeline(train, Q.LI_FEATURES)
    sc = features.vector_to_columns(pm.transform(train), "scaledFeatures",
                                    [f"s{i}" for i in range(4)])
    sd = sc.agg(*[F.stddev_samp(f"s{i}").alias(f"s{i}") for i in range(4)]).first()
    assert all(abs(sd[f"s{i}"] - 1.0) < 1e-9 for i in range(4))


def test_pca_ratios(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    arr = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    d = 64
    wide = arr.select("vec_id", *[F.col("e")[i].alias(f"e{i}") for i in range(d)])
    v = features.assemble(wide, [f"e{i}" for i in range(d)])
    sc = features.fit_standard_scaler(v).transform(v)
    pca = features.fit_pca(sc, 5)
    ev = [r.explained_variance for r in features.pca_explained(pca).orderBy("component").collect()]
    assert all(a >= b for a, b in zip(ev, ev[1:])) and sum(ev) <= 1.0 + 1e-12
    assert features.pca_table(sc, pca, keep=["vec_id"]).count() == emb.count()


def test_pca_sign_is_fixed(spark):
    _, pca = Q._pca_fitted(spark, SF001)
    pc = pca.pc.toArray()
    signs = features.pca_signs(pca)
    for j, s in enumerate(signs):
        first = next(v for v in pc[:, j] if abs(v) > 1e-6)
        assert first * s > 0


def test_two_auroc_forms_agree_on_hard_predictions(spark):
    # the reference computes AUROC twice: evaluator on the 0/1 prediction, and
    # pair metrics over (prediction, label); both must agree
    s = Q.lineitem_scored(spark, SF001)
    hard = {r.split: r.auroc for r in metrics.auroc_hard(s, group_cols=["split"]).collect()}
    pairs = {r.split: r.auroc for r in
             metrics.auroc_exact(s, "prediction", group_cols=["split"]).collect()}
    assert hard.keys() == pairs.keys()
    assert all(abs(hard[k] - pairs[k]) < 1e-12 for k in hard)


def test_row_index_column_is_not_nullable(spark):
    df = spark.createDataFrame([(3,), (1,)], "k long")
    assert align.row_index(df, ["k"]).schema["index"].nullable is False


def test_default_feature_list_is_name_difference(spark):
    df = spark.createDataFrame([(1, "M", 1.0, 2.0, 1)], "id int, d string, a double, b double, y int")
    out = features.assemble(df, exclude=["id", "d", "y"])
    assert out.schema["features"].metadata["ml_attr"]["num_attrs"] == 2


def test_score_split_frames_dict(spark):
    from cohortlab.operators import models
    from cohortlab.plans import model_data
    p = model_data.prepared(spark, SF001)
    m = {"logistic": model_data.fitted(spark, SF001, "logistic")}
    parts = split.split_frames(p, "split")
    a = models.score_splits(m, parts, ["doc_id"])
    b = models.score_splits(m, p, ["doc_id"])
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abcé€z0 ", max_size=12), min_size=0, max_size=60, unique=True),
       st.integers(1, 6))
def test_row_index_string_keys(spark, keys, ranges):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r["index"] for r in align.row_index(df, ["k"], ranges=ranges).collect()}
    want = {k: i for i, k in enumerate(sorted(keys, key=lambda s: s.encode("utf-8")))}
    assert got == want


def test_row_index_dates_and_current_order(spark):
    import datetime as dt
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=d) for d in (40, 3, 17, 400, 0)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r.d: r["index"] for r in align.row_index(df, ["d"], ranges=3).collect()}
    assert got == {d: i for i, d in enumerate(sorted(days))}
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey")
    idx = align.row_index(o, None).orderBy("index")
    rows = idx.collect()
    assert [r["index"] for r in rows] == list(range(o.count()))
    # current (file) order is kept: the scan order of the keys
    assert [r.o_orderkey for r in rows] == [r.o_orderkey for r in o.collect()]


def _largest(df, cols, n=64):
    from cohortlab.operators.ranges import range_parts
    rows = range_parts(df, cols, n).groupBy("_part").count().collect()
    return max(r["count"] for r in rows), sum(r["count"] for r in rows) / n


def test_hot_order_values_are_spread(spark):
    # a third of the rows share the first value, whatever its type, or a prefix of the order
    n = 60_000
    base = spark.range(n).withColumn("hot", F.col("id") % 3 == 0)
    pick = lambda hot, other: F.when(F.col("hot"), hot).otherwise(other)
    i = F.col("id")
    cases = {
        "decimal": (base.select(pick(F.lit("7.25"), i.cast("string")).cast("decimal(12,2)").alias("a"),
                                i.alias("b")), ["a", "b"]),
        "large bigint": (base.select(pick(F.lit(1 << 60), i + (1 << 60)).alias("a"), i.alias("b")), ["a", "b"]),
        "hot pair": (base.select(pick(F.lit(1), i % 1000).alias("a"), pick(F.lit("x"), F.hex(i)).alias("b"),
                                 i.alias("c")), ["a", "b", "c"]),
        "binary second": (base.select(pick(F.lit(1), i).alias("a"), F.hex(i).cast("binary").alias("b")), ["a", "b"]),
        "odd string": (base.select(pick(F.lit("Customer#1"), F.lit("!")).alias("a"),
                                   F.format_string("Customer#%09d", i).alias("b")), ["a", "b"]),
        "urls": (base.select(pick(F.concat(F.lit("https://hot.example/same/path/"), i.cast("string")),
                                  F.concat(F.lit("https://x"), i.cast("string"))).alias("a")), ["a"]),
        "100 values": (base.select((i % 100).alias("a")), ["a"]),
        "nulls": (base.select(pick(F.lit(None).cast("int"), i.cast("int")).alias("a")), ["a"]),
    }
    for name, (df, cols) in cases.items():
        most, ideal = _largest(df, cols)
        assert most < 3 * ideal, (name, most, ideal)


def test_row_index_follows_all_order_columns(spark):
    df = spark.createDataFrame([(i % 3, f"s{i % 7}", i) for i in range(210)], "a int, b string, c int")
    got = {(r.a, r.b, r.c): r["index"] for r in align.row_index(df, ["a", "b", "c"], ranges=8).collect()}
    want = sorted(got, key=lambda k: (k[0], k[1].encode(), k[2]))
    assert got == {k: i for i, k in enumerate(want)}


def test_row_index_of_ties_and_nulls_is_dense(spark):
    df = spark.createDataFrame([(None,)] * 40 + [(5,)] * 40 + [(1,)] * 3, "d int")
    got = align.row_index(df, ["d"], ranges=8).collect()
    assert sorted(r["index"] for r in got) == list(range(83))
    assert {r["index"] for r in got if r.d is None} == set(range(40))
    assert {r["index"] for r in got if r.d == 1} == {40, 41, 42}


def test_row_index_reads_its_input_twice(spark):
    from cohortlab.operators import ranges as R
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(1000).select(F.col("id").alias("k")).mapInPandas(count, "k bigint")
    assert R.range_parts(df, ["k"], 4).count() == 1000
    assert seen.value <= 2 * 1000

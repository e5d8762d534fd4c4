"""Hand-made edge frames (FIXTURES F-D)."""

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import align, features, metrics, profile, split


def test_null_heavy_threshold(spark):
    cols = [f"c{i}" for i in range(10)]
    rows = [tuple([None] * 10),                 # 10 of 10 null -> dropped
            tuple([None] * 9 + [1]),            # 9 of 10 (= 90 %) -> dropped (>=)
            tuple([None] * 8 + [1, 2]),         # 8 of 10 -> kept
            tuple(range(10))]                   # none -> kept
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    kept = profile.drop_null_heavy_rows(df, frac=0.9)
    assert kept.count() == 2
    counts = sorted(r.null_count for r in profile.with_null_count(df).collect())
    assert counts == [0, 8, 9, 10]


def test_null_count_mixed_types_no_array(spark):
    # the reference's array over int + string + double fails under ANSI; the
    # per-column null test does not build that array
    df = spark.createDataFrame([(1, "M", 1.5), (None, None, 2.0)], "id int, d string, x double")
    assert [r.null_count for r in profile.with_null_count(df).orderBy("x").collect()] == [0, 2]


def test_null_class(spark):
    df = spark.createDataFrame([("M",), ("B",), (None,)], "diagnosis string")
    enc = profile.encode_label(df, "diagnosis", "M", out="y")
    assert sorted((r.diagnosis or "", r.y) for r in enc.collect()) == [("", 0), ("B", 0), ("M", 1)]
    keep = profile.encode_label(df, "diagnosis", "M", out="y", null_label="keep")
    assert [r.y for r in keep.filter(F.col("diagnosis").isNull()).collect()] == [None]
    assert profile.class_subset(df, "diagnosis", "B").count() == 1
    assert profile.class_subset(df, "diagnosis", "M").count() == 1


def test_constant_feature(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0), ("a", 5.0, 2.0), ("b", 5.0, 3.0)],
                               "k string, c double, x double")
    scaled = profile.scale_by_class(df, "k", ["c", "x"])
    assert all(r.c_scaled is None for r in scaled.collect())
    st = profile.class_stats(df, "k", ["c"])
    assert all(r.scaled_avg is None for r in
               profile.baseline_profile(st, "k").collect())
    v = features.assemble(df, ["c", "x"])
    m = features.fit_standard_scaler(v)
    out = features.vector_to_columns(m.transform(v), "scaledFeatures", ["c_s", "x_s"]).collect()
    assert all(r.c_s == 0.0 for r in out)


def test_lookup_duplicate_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id int, v double")
    assert profile.point_lookup(df, "id", 1).count() == 2
    assert profile.point_lookup(df, "id", 7).count() == 0
    assert profile.point_lookup(df, "id", 2, expect_one=True).count() == 1
    with pytest.raises(ValueError):
        profile.point_lookup(df, "id", 1, expect_one=True)
    with pytest.raises(ValueError):
        profile.point_lookup(df, "id", 7, expect_one=True)
    keys = spark.createDataFrame([(1,), (7,)], "id int")
    assert profile.point_lookup(df, "id", keys).count() == 2
    with pytest.raises(ValueError):
        profile.point_lookup(df, "id", keys, expect_one=True)


def test_single_class_auroc_null(spark):
    df = spark.createDataFrame([(1.0, 1, 0.3), (0.0, 1, 0.9)], "prediction double, label int, s double")
    assert metrics.auroc_hard(df).first().auroc is None
    assert metrics.auroc_exact(df, "s").first().auroc is None


def test_no_predicted_positive(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0), (0.0, 1)], "prediction double, label int")
    r = metrics.precision_recall(metrics.confusion_matrix(df)).first()
    assert r.precision is None and r.recall == 0.0
    assert (r.tp, r.fp, r.tn, r.fn, r.n) == (0, 0, 1, 2, 3)


def test_empty_frame_keeps_schema(spark):
    df = spark.createDataFrame([], "id long, k string, x double, y double")
    assert profile.drop_null_heavy_rows(df).columns == df.columns
    assert profile.class_stats(df, "k", ["x", "y"]).count() == 0
    assert profile.describe_long(df, ["x"]).first().n == 0
    assert profile.scale_by_class(df, "k", ["x"]).columns == df.columns + ["x_scaled"]
    assert split.three_way_split(df, ["id"]).count() == 0
    assert align.row_index(df, ["id"]).count() == 0
    cm = metrics.confusion_matrix(df.withColumn("prediction", F.col("x")).withColumn(
        "label", F.col("y")))
    assert cm.first().n == 0
    assert metrics.auroc_exact(df, "x", "y").count() == 1


def test_assembler_null_modes(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "id int, a double, b double")
    with pytest.raises(Exception):
        features.assemble(df, ["a", "b"], handle_invalid="error").collect()
    assert features.assemble(df, ["a", "b"], handle_invalid="skip").count() == 1
    kept = features.vector_to_columns(features.assemble(df, ["a", "b"], handle_invalid="keep"),
                                      "features", ["a2", "b2"], keep=["id"])
    r = kept.filter("id = 2").first()
    assert r.a2 != r.a2 and r.b2 == 3.0  # NaN for the null


def test_prediction_match_null_is_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (0.0, 1.0)],
                               "prediction double, label double")
    assert sorted(r.equal for r in metrics.prediction_match(df).collect()) == [0, 0, 1]


def test_scale_baseline_class(spark):
    df = spark.createDataFrame([("B", 0.0), ("B", 10.0), ("M", 20.0), ("M", 30.0)],
                               "k string, x double")
    st = profile.class_stats(df, "k", ["x"])
    own = {r.k: r.scaled_avg for r in profile.baseline_profile(st, "k").collect()}
    assert own == {"B": 0.5, "M": 0.5}
    base = {r.k: r.scaled_avg for r in
            profile.baseline_profile(st, "k", "baseline_class", "B").collect()}
    assert base == {"B": 0.5, "M": 2.5}


def test_broadcast_size_check(spark):
    from cohortlab.operators.broadcast import _parse_bytes, fits_broadcast, row_width
    assert _parse_bytes("10485760b") == 10485760 and _parse_bytes("10MB") == 10485760
    assert _parse_bytes("-1") == -1
    narrow = spark.createDataFrame([(1, 2.0)], "k int, v double")
    wide = spark.createDataFrame([tuple([1.0] * 400)], ", ".join(f"c{i} double" for i in range(400)))
    assert row_width(wide) >= 3200
    assert fits_broadcast(narrow, 1000)
    assert not fits_broadcast(wide, 10_000)          # 10k rows x 3.2 KB > 10 MB
    assert not fits_broadcast(narrow, 10_000_000)    # over the row cap
    from cohortlab.operators.broadcast import measured
    urls = spark.createDataFrame([("x" * 1000,)] * 2000, "u string")
    _, n, size = measured(urls)
    assert n == 2000 and size >= 2_000_000          # actual string bytes, not 20 per string


def test_cluster_settings_sizes_partitions():
    from cohortlab.session import cluster_settings
    c = cluster_settings(100 * 10 ** 12, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == -(-100 * 10 ** 12 // (2 * 1024 ** 3))
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 * 1024)
    small = cluster_settings(10 ** 6, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"


def test_fit_skips_null_labels(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    from cohortlab.operators import models
    rows = [(Vectors.dense([float(i), float(i % 3)]), float(i % 2)) for i in range(40)]
    rows += [(Vectors.dense([1.0, 2.0]), None)]
    schema = StructType([StructField("scaledFeatures", VectorUDT()),
                         StructField("label", DoubleType())])
    df = spark.createDataFrame(rows, schema)
    ms = models.fit_models(df, ["logistic", "random_forest"])
    scored = models.score_splits(ms, df.withColumn("id", F.monotonically_increasing_id()),
                                 ["id"], split_col=None)
    assert scored.count() == 82
    cm = {r.model: r for r in metrics.confusion_matrix(scored, group_cols=["model"]).collect()}
    assert all(r.n == 41 and r.wrong >= 1 for r in cm.values())


def test_row_index_with_null_keys(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (2,), (3,)], "k int")
    got = align.row_index(df, ["k"], ranges=3).collect()
    assert sorted(r["index"] for r in got) == [0, 1, 2, 3, 4]
    assert {r.k: r["index"] for r in got if r.k is not None} == {1: 2, 2: 3, 3: 4}
    # nulls sort first, as in Spark's ascending order
    assert sorted(r["index"] for r in align.row_index(df, ["k"], ranges=3).collect()
                  if r.k is None) == [0, 1]


def test_auroc_exact_null_group(spark):
    df = spark.createDataFrame([(None, 0.1, 1), (None, 0.3, 1), (None, 0.2, 0),
                                ("a", 0.1, 0), ("a", 0.9, 1)], "g string, s double, y int")
    got = {r.g: r.auroc for r in metrics.auroc_exact(df, "s", "y", ["g"], ranges=2).collect()}
    assert got == {None: 0.5, "a": 1.0}


def test_null_class_scaled_by_its_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 7.0)],
                               "k string, x double")
    got = sorted((r.k or "", r.x_scaled) for r in profile.scale_by_class(df, "k", ["x"]).collect())
    assert got == [("", 0.0), ("", 1.0), ("a", 0.0), ("a", 1.0)]


def test_null_heavy_without_columns(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert profile.drop_null_heavy_rows(df, cols=[]).count() == 2


def test_timestamp_ntz_order_independent_of_zone(spark):
    import datetime as dt
    ts = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 10),
          dt.datetime(2024, 3, 10, 1, 59), dt.datetime(2023, 11, 5, 1, 30)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.t: r["index"] for r in align.row_index(df, ["t"], ranges=3).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {t: i for i, t in enumerate(sorted(ts))}


def test_range_order_invariants(spark):
    from decimal import Decimal

    from cohortlab.operators.ranges import range_parts
    # decimals that collapse onto one double are not treated as one hot value
    rows = [(Decimal("1.00000000000000000001"), 10000)] + \
        [(Decimal("1.00000000000000000002"), i) for i in range(300)]
    df = spark.createDataFrame(rows, "d decimal(38,20), id int")
    got = [x["index"] for x in align.row_index(df, ["d", "id"], ranges=4).orderBy("d", "id").collect()]
    assert got == list(range(len(rows)))
    # -0.0 and 0.0 are equal keys
    z = spark.createDataFrame([(-0.0, 5), (0.0, 1), (1.0, 0), (-1.0, 0)] + [(0.0, i) for i in range(10, 40)],
                              "d double, id int")
    r = range_parts(z, ["d", "id"], 3)
    ids = [x["_part"] for x in r.orderBy("d", "id").collect()]
    assert ids == sorted(ids)
    # a second column without numbers
    b = spark.createDataFrame([(5, bytearray([i % 256])) for i in range(60)] + [(i, bytearray([0])) for i in range(30)],
                              "d int, b binary")
    assert align.row_index(b, ["d", "b"], ranges=4).count() == 90
    # ranges=0 means one range
    assert range_parts(z, ["d"], 0).select("_part").distinct().count() == 1


def test_lookup_null_key_consistent(spark):
    df = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    keys = spark.createDataFrame([(None,)], "k int")
    assert profile.point_lookup(df, "k", keys, expect_one=True).count() == 1
    assert profile.point_lookup(df, "k", None, expect_one=True).count() == 1
    assert profile.point_lookup(df, "k", [None, 2]).count() == 2


def test_scale_by_class_with_given_stats(spark):
    from cohortlab.plans import queries as Q
    from tests.conftest import SF001
    li = Q.lineitem(spark, SF001)
    st = profile.class_stats(li, Q.LI_LABEL, Q.LI_FEATURES)
    a = profile.scale_by_class(li, Q.LI_LABEL, Q.LI_FEATURES)
    b = profile.scale_by_class(li, Q.LI_LABEL, Q.LI_FEATURES, stats=st)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_expect_one_casts_scalar_keys(spark):
    df = spark.createDataFrame([(5.0, 1), (6.0, 2)], "price double, v int")
    assert profile.point_lookup(df, "price", 5, expect_one=True).count() == 1


def test_measured_counts_nested_lengths(spark):
    from cohortlab.operators.broadcast import measured
    nested = spark.createDataFrame([(("x" * 1000,), ["y" * 1000])] * 500,
                                   "s struct<u:string>, a array<string>")
    _, n, size = measured(nested)
    assert n == 500 and size >= 1_000_000


def test_no_local_checkpoint_fallback_on_a_cluster():
    from cohortlab.session import ensure_checkpoint_dir

    class Ctx:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Ctx()
        conf = Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_lookup_equals_semi_join_for_every_key_type_and_size(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # hourly wall-clock times across both changes of daylight saving time
        base = spark.range(12_000).select("id", F.expr(
            "timestamp_ntz'2023-11-01 00:30:00' + make_dt_interval(0, cast(id as int))").alias("ntz"))
        t = base.select("id", "ntz", F.expr("timestamp_micros(id * 3600000000)").alias("ts"),
                        F.expr("date_from_unix_date(cast(id as int))").alias("date"),
                        (F.col("id") / 4).cast("decimal(12,2)").alias("dec"),
                        F.hex("id").cast("binary").alias("bin"), F.array("id").alias("arr"),
                        F.format_string("k%d", "id").alias("str"))
        for n in (1, 900, 1000, 1001, 1100):
            keys = t.filter(F.col("id") % 7 == 3).limit(n)
            for c in ("id", "ntz", "ts", "date", "dec", "bin", "arr", "str"):
                got = profile.point_lookup(t, c, keys.select(c), cols=["id"])
                want = t.join(keys.select(c), c, "left_semi")
                assert got.count() == want.count() == n, (c, n)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_one_round_score_is_the_step_of_its_leaf(spark):
    import math

    from cohortlab.operators import models
    from cohortlab.plans import model_data
    from tests.conftest import SF001
    m = model_data.fitted(spark, SF001, "boosted_one_round")
    assert len(m.trees) == 1 and m.base == 0.0
    s = m.settings
    for n in m.trees[0]:
        assert n.value == (0.0 if n.feature >= 0 else -s.step * n.g / (n.h + s.l2))
    rows = model_data.prepared(spark, SF001).limit(50)
    margin = {r.doc_id: r.margin for r in m.transform(rows).collect()}
    got = models.score_splits({"boosted_one_round": m}, rows, ["doc_id"]).collect()
    assert len(got) == 50
    for r in got:
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin[r.doc_id])), abs_tol=1e-12)
        assert r.prediction == float(margin[r.doc_id] > 0)

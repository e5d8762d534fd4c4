"""Operators against plain-Python brute force on random frames (hypothesis)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlab.operators import metrics, profile, split

SETTINGS = dict(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))

pred_label = st.lists(st.tuples(st.sampled_from([0.0, 1.0, None]), st.sampled_from([0, 1, None]),
                                st.sampled_from(["a", "b", None])), min_size=0, max_size=40)


@settings(**SETTINGS)
@given(pred_label)
def test_confusion_matrix_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "prediction double, label int, g string")
    got = {r.g: (r.n, r.correct, r.wrong, r.tp, r.tn, r.fp, r.fn)
           for r in metrics.confusion_matrix(df, group_cols=["g"]).collect()}
    want = {}
    for p, y, g in rows:
        n, c, w, tp, tn, fp, fn = want.get(g, (0, 0, 0, 0, 0, 0, 0))
        eq = p is not None and y is not None and p == y
        want[g] = (n + 1, c + eq, w + (not eq),
                   tp + (p == 1.0 and y == 1), tn + (p == 0.0 and y == 0),
                   fp + (p == 1.0 and y == 0), fn + (p == 0.0 and y == 1))
    assert got == want


values = st.lists(st.tuples(st.sampled_from(["x", "y", None]),
                            st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False))),
                  min_size=0, max_size=40)


@settings(**SETTINGS)
@given(values)
def test_class_stats_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.avg_value, r.min_value, r.max_value)
           for r in profile.class_stats(df, "k", ["v"]).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        xs = [v for v in vs if v is not None]
        n, avg, lo, hi = got[k]
        assert n == len(xs)
        if xs:
            assert math.isclose(avg, sum(xs) / len(xs), rel_tol=1e-9, abs_tol=1e-6)
            assert (lo, hi) == (min(xs), max(xs))
        else:
            assert avg is None and lo is None and hi is None


@settings(**SETTINGS)
@given(st.lists(st.floats(0.01, 10), min_size=2, max_size=4))
def test_hash_split_shares_follow_weights(spark, weights):
    names = [f"p{i}" for i in range(len(weights))]
    df = spark.range(20000)
    out = split.hash_split(df, ["id"], weights, "s", names)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    total = sum(weights)
    for name, w in zip(names, weights):
        assert abs(counts.get(name, 0) / 20000 - w / total) < 0.02


@settings(**SETTINGS)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=4, max_size=4),
                min_size=0, max_size=30), st.sampled_from([0.5, 0.75, 0.9, 1.0]))
def test_null_heavy_brute_force(spark, rows, frac):
    df = spark.createDataFrame([tuple(r) for r in rows], "a int, b int, c int, d int")
    kept = profile.drop_null_heavy_rows(df, frac=frac).count()
    assert kept == sum(1 for r in rows if not (sum(v is None for v in r) >= frac * 4))


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2", None]), st.integers(-50, 50),
                          st.integers(0, 9)), min_size=0, max_size=60, unique_by=lambda t: (t[0], t[1])),
       st.integers(1, 6))
def test_exclusive_prefix_brute_force(spark, rows, ranges):
    from cohortlab.operators.ranges import exclusive_prefix
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.before for r in
           exclusive_prefix(df, ["k"], "v", "before", ["g"], ranges=ranges).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        acc = 0
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            want[(g, k)] = acc
            acc += v
    assert got == want


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-100, 100)), min_size=0, max_size=80,
                unique=True), st.integers(1, 8))
def test_row_index_two_keys_brute_force(spark, rows, ranges):
    from cohortlab.operators import align
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r.a, r.b): r["index"] for r in align.row_index(df, ["a", "b"], ranges=ranges).collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows))}


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=0, max_size=30),
       st.lists(st.one_of(st.none(), st.integers(0, 8)), min_size=1, max_size=6))
def test_point_lookup_brute_force(spark, ids, keys):
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id int, n int")
    kdf = spark.createDataFrame([(k,) for k in keys], "id int")
    got = sorted(r.n for r in profile.point_lookup(df, "id", kdf).collect())
    assert got == sorted(n for n, i in enumerate(ids) if i in set(keys))
    got2 = sorted(r.n for r in profile.point_lookup(df, "id", keys).collect())
    assert got2 == got

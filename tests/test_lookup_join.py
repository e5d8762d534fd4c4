"""Lookups beyond a broadcast (P8) and joins of tables cut at the same ranks."""

import os
from contextlib import contextmanager

from pyspark.sql import functions as F

from cohortlab.operators import align, profile
from cohortlab.session import cluster_settings, lookup_settings
from tests.conftest import SF001
from tests.test_plans import nodes, formatted


@contextmanager
def settings(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
BLOOM = {**SHUFFLED, **lookup_settings(100_000),
         "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}


def below(node):
    """A physical plan node and all nodes under it."""
    out, kids = [node], node.children()
    for i in range(kids.size()):
        out += below(kids.apply(i))
    return out


def shuffled_rows(df) -> list[int]:
    """Rows written by each shuffle of the main plan of ``df``, most first."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return sorted((n.metrics().get("shuffleRecordsWritten").get().value()
                   for n in below(qe.executedPlan()) if n.nodeName() == "Exchange"), reverse=True)


def test_bloom_filter_thins_rows_before_the_shuffle(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    keys = li.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(100)) == 0).select("l_orderkey")
    want = li.join(keys.distinct(), "l_orderkey", "left_semi").count()
    with settings(spark, BLOOM):
        got = profile.point_lookup(li, "l_orderkey", keys, cols=["l_linenumber"])
        p = formatted(got)
        assert got.count() == want > 0
        rows = shuffled_rows(got)
    main = p.split("===== Subqueries")[0]
    assert "might_contain" in main and nodes(main, "Exchange") == 2
    assert rows[0] <= 0.03 * li.count()


def test_lookup_beyond_a_broadcast_keeps_null_keys_and_repeats(spark):
    rows = [(1, "a", 10), (1, "a", 11), (1, None, 12), (None, "b", 13), (None, None, 14), (2, "a", 15), (3, "b", 16)]
    df = spark.createDataFrame(rows, "k long, s string, v long")
    keys = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, None), (9, "z")], "k long, s string")
    for conf in (BLOOM, SHUFFLED):
        with settings(spark, conf):
            far = sorted(r.v for r in profile.point_lookup(df, ["k", "s"], keys, max_broadcast_rows=0).collect())
            near = sorted(r.v for r in profile.point_lookup(df, ["k", "s"], keys).collect())
        assert far == near == [10, 11, 12, 14]
    none = keys.limit(0)
    assert profile.point_lookup(df, ["k", "s"], none, max_broadcast_rows=0).count() == 0


def test_ranked_tables_join_without_a_shuffle(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    a = align.row_index(o.select("o_orderkey", "o_custkey"), ["o_orderkey"], ranges=5)
    b = align.row_index(o.select("o_orderkey", "o_totalprice"), ["o_orderkey"], ranges=3).drop("o_orderkey")
    want = sorted(align.positional_join(a, b).collect())
    left, right = align.ranked_tables([a, b], buckets=4, names=["ranked_a", "ranked_b"])
    co = cluster_settings(1, 8)["spark.sql.requireAllClusterKeysForCoPartition"]
    for need_all, shuffles in ((co, 0), ("true", 2)):
        with settings(spark, {**SHUFFLED, "spark.sql.requireAllClusterKeysForCoPartition": need_all}):
            got = align.ranked_join(left, right)
            assert nodes(formatted(got), "Exchange") == shuffles
            assert sorted(got.collect()) == want and len(want) == o.count()
    folders = {f.rsplit("/", 1)[0].removeprefix("file://") for f in left.inputFiles() + right.inputFiles()}
    assert len(folders) == 2 and all(os.path.isdir(f) for f in folders)
    align.drop_ranked(spark, "ranked_a", "ranked_b")
    assert not spark.catalog.tableExists("ranked_a") and not any(os.path.exists(f) for f in folders)


def test_ranked_tables_of_unequal_and_empty_frames(spark):
    a = spark.range(10).select(F.col("id").alias("index"), (F.col("id") * 2).alias("x"))
    b = spark.range(7).select(F.col("id").alias("index"), (F.col("id") * 3).alias("y"))
    left, right = align.ranked_tables([a, b], buckets=3)
    assert sorted(align.ranked_join(left, right, keep_index=True).collect()) == [(i, 2 * i, 3 * i) for i in range(7)]
    left, right = align.ranked_tables([a.limit(0), b.limit(0)], buckets=3)
    assert align.ranked_join(left, right).count() == 0

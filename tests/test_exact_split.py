"""Exact split sizes per class against a sort, with hot, tiny, null and repeated keys."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import split
from tests.test_plans import formatted


@pytest.mark.parametrize("share", [0.8, 0.5, 0.0, 1.0])
def test_equals_a_sort(spark, share):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"c{i % 7}") for i in range(3000)] + [(9999, "one")]
    df = spark.createDataFrame(rows, "k long, c string").withColumn("split", F.lit("own")).repartition(9)
    got = {r.k: r.split for r in split.exact_split(df, ["k"], "c", share).collect()}
    by = defaultdict(list)
    for k, c in rows:
        by[c].append((hashlib.md5(f"12345:{k}".encode()).hexdigest(), k))
    want = {k: ("train" if i < math.floor(share * len(v)) else "test") for v in by.values()
            for i, (_, k) in enumerate(sorted(v))}
    assert got == want


def test_repeated_keys_stay_together_and_empty(spark):
    df = spark.createDataFrame([(1, "a")] * 6 + [(2, "a")] * 4, "k long, c string")
    got = split.exact_split(df, ["k"], "c", 0.5).groupBy("k").agg(F.count_distinct("split").alias("n"),
                                                                  F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in got)
    assert sum({1: 6, 2: 4}[r.k] for r in got if r.s == "train") <= 5
    assert split.exact_split(df.limit(0), ["k"], "c").count() == 0


def test_no_window_over_the_rows_of_a_class(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("c"))
    assert "Window" not in formatted(split.exact_split(df, ["id"], "c"))

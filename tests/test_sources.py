"""Sources: CSV round trip with and without inference, views with parameters,
frame references, persistence and lineage cuts."""

from pyspark.sql import functions as F

from cohortlab.sources import (cut_lineage, persist_parts, read_csv, sql_over, unpersist_parts,
                               view_sql, write_csv)
from cohortlab.sources.cache import rebalance
from tests.conftest import SF001


def test_csv_inference_keeps_int_keys(spark):
    nation = spark.read.parquet(f"{SF001}/nation.parquet")
    path = write_csv(nation)
    back = read_csv(spark, path)
    assert dict(back.dtypes) == {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}
    assert sorted(back.collect()) == sorted(nation.collect())
    sampled = read_csv(spark, path, sampling_ratio=0.5)
    assert sampled.count() == 25
    typed = read_csv(spark, path, schema=nation.schema)
    assert typed.schema == nation.schema


def test_view_sql_parameters_and_frame_refs(spark):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    k = orders.agg(F.min("o_orderkey")).first()[0]
    one = view_sql(spark, "SELECT o_orderkey FROM cohort_orders WHERE o_orderkey = :k",
                   views={"cohort_orders": orders}, args={"k": k})
    assert [r.o_orderkey for r in one.collect()] == [k]
    n = sql_over(spark, "SELECT count(*) AS n FROM {t} WHERE o_totalprice > :p",
                 args={"p": 0.0}, t=orders).first().n
    assert n == orders.filter("o_totalprice > 0").count()


def test_persist_and_cut_lineage(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    (p,) = persist_parts(df)
    assert p.count() == 100
    unpersist_parts(p)
    cut = cut_lineage(df)
    assert "ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == 100


def test_rebalance_by_rows(spark):
    df = spark.range(0, 1000, numPartitions=50)
    cores = spark.sparkContext.defaultParallelism
    for per, fewest, want in ((300, 300, max(4, min(cores, 3))), (100, 50, max(10, min(cores, 20))),
                              (1_000_000, 20_000, 1), (1_000_000, 100, min(cores, 10))):
        out = rebalance(df, rows_per_partition=per, fewest_rows=fewest)
        assert out.rdd.getNumPartitions() == want and out.count() == 1000, (per, fewest)

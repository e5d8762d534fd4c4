"""Plan shape: what the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F

from cohortlab.operators import align, profile, split
from cohortlab.plans import queries as Q
from tests.conftest import SF001


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(p: str, name: str) -> int:
    """Number of physical nodes called ``name`` in a formatted plan."""
    return len(re.findall(rf"^\(\d+\) {name}\b", p, flags=re.M))


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchanges(p: str) -> list[tuple[str, str]]:
    """(columns that go in, how they are dealt) of every shuffle in a formatted plan."""
    out = []
    for block in re.split(r"\n\n+", p):
        if re.match(r"\(\d+\) Exchange\b", block):
            cols = re.search(r"^Input \[\d+\]: \[(.*)\]", block, flags=re.M)
            args = re.search(r"^Arguments: (.*)", block, flags=re.M)
            out.append((cols[1] if cols else "", args[1] if args else ""))
    return out


def test_exchanges_are_seen(spark):
    # the checks below rest on this: a plan that does shuffle is reported
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bad = exchanges(formatted(docs.select("doc_id", "text").repartition(4, "doc_id")))
    assert len(bad) == 1 and "text#" in bad[0][0] and "hashpartitioning(doc_id" in bad[0][1]
    li = Q.lineitem(spark, SF001)
    joined = li.join(li.groupBy("l_returnflag").count().hint("merge"), "l_returnflag")
    assert any("l_quantity#" in c for c, _ in exchanges(formatted(joined)))


def test_profile_is_one_scan_one_exchange_no_python(spark):
    p = formatted(Q.q_class_profile(spark, SF001))
    assert nodes(p, "Scan parquet") == 1
    assert nodes(p, "Exchange") == 1
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # only the five used columns are read
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double," \
           "l_tax:double,l_returnflag:string>" in p


def test_no_python_udf_anywhere(spark):
    for key, fn in Q.REGISTRY.items():
        if key.startswith(("clf_", "score_", "logistic", "model_", "csv_")):
            continue
        p = formatted(fn(spark, SF001))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key


def test_scale_by_class_does_not_shuffle_rows(spark):
    p = formatted(Q.q_min_max_scale(spark, SF001))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert not any("l_orderkey#" in c for c, _ in exchanges(p))   # rows stay where they are


def test_pca_table_has_no_join(spark):
    p = formatted(Q.q_pca_table(spark, SF001))
    assert "Join" not in p


def test_split_is_narrow(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = formatted(split.three_way_split(o, ["o_orderkey"]))
    assert "Exchange" not in p


def test_lookup_pushes_keys_to_scan(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = formatted(profile.point_lookup(o, "o_orderkey", [7, 11]))
    assert "PushedFilters: [In(o_orderkey, [11,7])" in p or "In(o_orderkey" in p
    keys = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))
    p2 = formatted(profile.point_lookup(o, "o_orderkey", keys))
    # the span of the keys prunes row groups; the semi join decides, at every size
    assert "GreaterThanOrEqual(o_orderkey" in p2 and "LeftSemi" in p2 and "In(o_orderkey" not in p2


def test_row_index_has_no_single_partition_window(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey")
    p = formatted(align.row_index(o, ["o_orderkey"]))
    assert nodes(p, "Window") == 0          # a row's place in its partition is its count
    assert not any("SinglePartition" in a and "o_orderkey#" in c for c, a in exchanges(p))


def test_auroc_exact_pre_aggregates_before_shuffle(spark):
    from cohortlab.operators import metrics
    s = Q.lineitem_scored(spark, SF001)
    p = formatted(metrics.auroc_exact(s, "score", "label", ["split"], materialize=False))
    counts = formatted(metrics.score_counts(s, "score", "label", ["split"]))
    assert "partial_count_if(" in counts or "partial_count(" in counts   # combined before the shuffle
    assert nodes(counts, "Exchange") == 1
    assert nodes(p, "Window") == 1          # within partition and group only


def test_text_is_not_shuffled(spark):
    from cohortlab.plans import model_data
    p = formatted(model_data.labelled(spark, SF001))
    assert not any("text#" in c for c, _ in exchanges(p))

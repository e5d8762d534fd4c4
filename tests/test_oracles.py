"""Every SQL-expressible registered query equals its DuckDB oracle at sf0.01."""

import pytest

import __spark_entry__ as contract
from cohortlab.plans.verify import compare, type_diffs
from tests.conftest import SF001, SF0001

ORACLE = contract.oracle_sql()


def test_every_oracle_key_is_registered():
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck001, key):
    df = contract.queries()[key](spark, SF001)
    res = compare(df, duck001, ORACLE[key], digits=None)
    assert res["ok"], res
    assert type_diffs(df, duck001, ORACLE[key]) == []


def test_entry_smoke(spark):
    df = contract.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert df.columns == ["l_returnflag", "attribute", "n", "avg_value", "min_value",
                          "max_value", "scaled_avg"]


def test_queries_run_at_smallest_sf(spark):
    qs = contract.queries()
    for k in ("class_profile", "record_profile", "auroc_exact", "row_index", "split_train_val"):
        assert qs[k](spark, SF0001).count() >= 1


FALLBACK_KEYS = ["min_max_scale", "record_profile", "point_lookup", "row_index", "auroc_exact",
                 "positional_join"]


@pytest.mark.parametrize("key", FALLBACK_KEYS)
def test_shuffle_join_fallback_matches(spark, duck001, key):
    """With broadcasting disabled, the size-checked joins take the shuffle path
    and the results are unchanged."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = contract.queries()[key](spark, SF001)
        from tests.test_plans import formatted
        assert "BroadcastHashJoin" not in formatted(df)
        res = compare(df, duck001, ORACLE[key])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert res["ok"], res

"""Where the test tables live and how the plans name their columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# lineitem stands in for the reference's labelled table: class = return flag,
# features = its four measures, record key = the four key columns.
LI_LABEL = "l_returnflag"
LI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LI_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LI_CLASSES = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

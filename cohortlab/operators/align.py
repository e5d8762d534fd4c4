"""Row index and positional join.

The reference numbers rows by ``rdd.zipWithIndex`` and joins two projections on
that number. In PySpark a trip through ``df.rdd`` pickles every row into Python,
so the index here is built from DataFrame operations instead: an explicit order
(``order_cols`` must be a total order, or the numbering among ties is
arbitrary; any orderable types), sorted range partitions, each row's place in
its partition, and an offset table of one row per partition. Without an order,
rows are numbered in their current order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.ranges import exclusive_prefix
from cohortlab.session import shared_dir
from cohortlab.sources.cache import cut_lineage

BLOCK = "_block"


def row_index(df: DataFrame, order_cols: Sequence[str] | None, out: str = "index",
              ranges: int | None = None) -> DataFrame:
    """Add a dense 0-based ``out`` (long, not null) following ``order_cols``.

    ``order_cols=None`` numbers the rows in their current order, as the
    reference's ``zipWithIndex`` does: each row is tagged with
    ``monotonically_increasing_id`` (increasing within and across partitions)
    and the tagged rows are checkpointed, so every job below sees the same tags.
    The sorted partitions are checkpointed as well (one write of the frame).
    """
    if order_cols is None:
        tag = "_row_order"
        tagged = cut_lineage(df.withColumn(tag, F.monotonically_increasing_id()))
        return row_index(tagged, [tag], out, ranges).drop(tag)
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    res = exclusive_prefix(df, list(order_cols), None, out, ranges=ranges)
    return res.withColumn(out, F.coalesce(F.col(out).cast("long"), F.lit(0).cast("long")))


def positional_join(left: DataFrame, right: DataFrame, index_col: str = "index",
                    keep_index: bool = False) -> DataFrame:
    """Inner equi join on the row index, then drop it (J2 + P11).

    Both sides hash-partition on the index (or one side is broadcast when
    Spark measures it small). When both frames are projections of one parent,
    select the columns from the parent instead: that needs no join at all.
    """
    out = left.join(right, on=[index_col], how="inner")
    return out if keep_index else out.drop(index_col)


def ranked_tables(frames: Sequence[DataFrame], index_col: str = "index", buckets: int | None = None,
                  blocks_per_bucket: int = 8, names: Sequence[str] | None = None) -> list[DataFrame]:
    """Indexed frames kept as tables that are cut at the same ranks and bucketed alike.

    A block is a run of ``index_col`` of one length in all frames; the tables are bucketed by block
    and sorted by index. Rows of ``row_index`` lie in runs of the index already, so each writing
    task touches few blocks and the write itself shuffles nothing. ``ranked_join`` joins such
    tables without a shuffle, once or many times. The files lie in the shared folder; ``buckets``
    defaults to the session's shuffle partitions, ``names`` to fresh table names (give some
    to remove the tables by ``drop_ranked``).
    """
    spark = frames[0].sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions") if buckets is None else buckets))
    top = max((f.agg(F.max(index_col)).first()[0] or 0) for f in frames) + 1
    length = -(-top // (n * blocks_per_bucket))
    out = []
    for f, name in zip(frames, names or [f"ranked_{uuid.uuid4().hex}" for _ in frames], strict=True):
        (f.withColumn(BLOCK, F.floor(F.col(index_col) / F.lit(length)).cast("long"))
         .write.bucketBy(n, BLOCK).sortBy(index_col).option("path", shared_dir(spark, "ranked"))
         .saveAsTable(name))
        out.append(spark.table(name))
    return out


def ranked_join(left: DataFrame, right: DataFrame, index_col: str = "index",
                keep_index: bool = False) -> DataFrame:
    """``positional_join`` of two ``ranked_tables``: their buckets meet as they lie. Spark leaves out
    the shuffle where ``spark.sql.requireAllClusterKeysForCoPartition`` is false
    (``session.cluster_settings``); with the setting on it shuffles, with the same result."""
    out = left.join(right, on=[BLOCK, index_col], how="inner").drop(BLOCK)
    return out if keep_index else out.drop(index_col)


def drop_ranked(spark: SparkSession, *names: str) -> None:
    """Remove ``ranked_tables`` that are no longer read, files included."""
    for name in names:
        where = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"]
        spark.sql(f"DROP TABLE {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def select_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Plain projection (P10); pruned down to the scan."""
    return df.select(*cols)


def drop_column(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns."""
    return df.drop(*cols)

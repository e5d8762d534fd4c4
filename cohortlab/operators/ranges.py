"""Ordered prefix sums without a single-partition window.

A global running sum (``sum(x) over (order by k)``) puts every row into one
task. Here Spark's own range partitioner deals the rows out by all order
columns, with the row position as a last tie-breaker, so a hot value is spread
whatever its type or place in the order. The sorted partitions are checkpointed
once; what lies before a partition comes from a table of one row per partition
(and group). The result equals the global running sum exactly; only the balance
of the partitions is approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import qcol
from cohortlab.operators.broadcast import bounded_broadcast
from cohortlab.sources.cache import cut_lineage

PART, AT = "_part", "_at"
_ROW_BITS = 33               # monotonically_increasing_id: partition number, then row number


def range_parts(df: DataFrame, order_cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` in sorted range partitions, with the partition number ``_part`` and
    the row's place in it ``_at``. If row a precedes row b in the order of
    ``order_cols``, a's partition is not after b's; equal rows may be cut apart.

    ``ranges`` partitions (default: the session's shuffle partitions). The input
    is read twice: for the partitioner's sample and for the shuffle.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions") if ranges is None else ranges))
    cols, tie = [qcol(c) for c in order_cols], "_tie"
    d = df.withColumn(tie, F.monotonically_increasing_id())
    d = d.repartitionByRange(n, *cols, tie).sortWithinPartitions(*cols, tie).drop(tie)
    row = F.monotonically_increasing_id()
    return cut_lineage(d).select("*", F.shiftright(row, _ROW_BITS).cast("int").alias(PART),
                                 row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(AT))


def exclusive_prefix(df: DataFrame, order_cols: Sequence[str], value_col: str | None,
                     out: str, group_cols: Sequence[str] = (),
                     ranges: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value_col`` over rows strictly before this one in
    ``order_cols`` order (within ``group_cols``). ``value_col=None`` counts rows,
    which gives a dense 0-based row number.

    Rows with a null group key form their own group, as in ``groupBy``.
    """
    gk = "_group_key"
    d = range_parts(df, list(order_cols), ranges)
    v = F.lit(1).cast("long") if value_col is None else F.col(value_col)
    # The groups travel as one struct column: it is never null, and structs
    # with equal fields (nulls included) group and join as equal, so the
    # window, the totals and the offset join all key on the same plain
    # columns.
    keys = [gk, PART] if group_cols else [PART]
    if group_cols:
        d = d.withColumn(gk, F.struct(*[qcol(c) for c in group_cols]))
    if value_col is None and not group_cols:
        d = d.withColumn("_in_part", F.col(AT))       # its place is the count: no window
    else:
        w_in = Window.partitionBy(*keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("_in_part", F.coalesce(F.sum(v).over(w_in), F.lit(0)))
    totals = d.groupBy(*keys).agg(F.sum(v).alias("_tot"))
    w_off = (Window.partitionBy(*keys[:-1]).orderBy(PART)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, F.coalesce(F.sum("_tot").over(w_off), F.lit(0)).alias("_off"))
    offsets = bounded_broadcast(offsets)
    return (d.join(offsets, on=keys, how="left")
            .withColumn(out, F.col("_in_part") + F.col("_off"))
            .drop("_in_part", "_off", AT, *keys))

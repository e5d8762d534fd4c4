"""Keeping split outputs around (S4) and cutting lineage.

``persist_parts`` keeps the frames the model fits iterate over
(MEMORY_AND_DISK: an evicted or lost block is recomputed from lineage or read
from disk, never silently dropped). ``cut_lineage`` writes a reliable
checkpoint into the cluster's shared checkpoint folder; a machine-local
checkpoint would not survive the loss of that executor.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from cohortlab.session import ensure_checkpoint_dir


def persist_parts(*frames: DataFrame) -> list[DataFrame]:
    return [f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames]


def unpersist_parts(*frames: DataFrame) -> None:
    for f in frames:
        f.unpersist()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


ROWS_PER_PARTITION = 1_000_000
#: A partition with fewer rows costs an iterative fit more in tasks than it saves.
FEWEST_ROWS = 20_000


def rebalance(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION,
              fewest_rows: int = FEWEST_ROWS) -> DataFrame:
    """Checkpoint ``df`` and size its partitions by row count.

    For narrow rows made from wide ones (a few features computed from a long
    text), the input layout leaves many tiny partitions; every iteration of a
    model fit would pay one task per partition. The checkpoint keeps the small
    rows (the wide input is not read again), then they are coalesced (or
    spread, if too few) to about ``rows_per_partition`` rows each. Up to the
    session's parallelism there are more partitions than that, as long as each
    holds ``fewest_rows`` rows.
    """
    df = cut_lineage(df)
    n = df.count()
    have = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    want = max(1, -(-n // rows_per_partition), min(cores, n // max(1, min(fewest_rows, rows_per_partition))))
    if want < have:
        return df.coalesce(want)
    if want > have:
        return df.repartition(want)
    return df

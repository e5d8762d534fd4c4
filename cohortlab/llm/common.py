"""Shared pieces of the operators: table access and written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import shared_dir

#: A side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024

#: Bytes of an Arrow batch of a Python stage, unless the session names its own: long texts
#: would otherwise make batches of ten thousand rows large.
ARROW_BYTES = 4 * 1024 * 1024
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_ARROW, None) is None:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, in whatever store it lies."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_HELD: list[list["Scratch"]] = []


@contextmanager
def released() -> Iterator[None]:
    """Drop the intermediates that are opened inside once the block ends; for a
    caller that has written the block's result by then."""
    _HELD.append([])
    try:
        yield
    finally:
        for sc in _HELD.pop():
            sc.drop(*list(sc.paths))


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    ``put`` runs a plan once, writes it and returns a scan of the files, so a
    lost executor costs a re-read and the lineage is cut; ``drop`` removes a
    table that is no longer read. Tables behind a returned result stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, shared_dir(spark, label)
        self.paths: dict[str, str] = {}
        if _HELD:
            _HELD[-1].append(self)

    def path(self, name: str) -> str:
        return self.paths.setdefault(name, f"{self.base}/{name}")

    def put(self, name: str, df: DataFrame, fmt: str = "parquet", **options) -> DataFrame:
        path = self.path(name)
        df.write.format(fmt).options(**options).save(path)
        return self.spark.read.schema(df.schema).format(fmt).load(path)

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.paths:
                delete_path(self.spark, self.paths.pop(n))


def join_small(big: DataFrame, small: DataFrame, on, how: str, n_small: int,
               row_bytes: int) -> DataFrame:
    """Join with ``small`` broadcast when its counted rows fit, shuffled otherwise."""
    fits = n_small * row_bytes <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if fits else small, on, how)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``dropped`` (doc_id); all columns stay.

    The ids to drop are written once and counted: they are broadcast while they
    fit, and shuffled with the documents beyond that."""
    ids = Scratch(docs.sparkSession, "without").put("ids", dropped.select("doc_id").distinct())
    return join_small(docs, ids, "doc_id", "left_anti", ids.count(), 16)

"""The scoring and confusion-count operators over a streaming source.

The reference has no stream. Its score tables (C6), confusion counts (A6) and
class profile (A2-A4, F3) are plain projections and one aggregate, so the same
functions run unchanged on a streaming DataFrame: fitted models ``transform``
micro-batches, and the counts and class statistics are stateful streaming
aggregations (``complete`` mode; ``update`` for the counts). Query state and progress go to a checkpoint location under the
cluster's shared folder, so a restarted query resumes instead of recounting.

Exact AUROC (A9) needs an order over all rows, but only through the counts of positives
and negatives per score. Those are kept as streaming state (``keep_score_counts``), written
as a table after every micro-batch, and the area is a prefix sum over the newest table
(``auroc_now``), so it equals the batch result over the rows seen so far.

Not available on a stream: ``row_index`` (it needs an ordered pass over the whole input).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortlab.operators import metrics, models
from cohortlab.session import shared_dir


def read_parquet_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def score_stream(fitted: dict, stream: DataFrame, id_cols: Sequence[str],
                 label_col: str = "label", split_col: str | None = None) -> DataFrame:
    """C6 over a stream: one row per (model, input row)."""
    return models.score_splits(fitted, stream, id_cols, label_col, split_col)


def running_confusion(scored: DataFrame, pred_col: str = "prediction", label_col: str = "label",
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """A6 over a stream: counts kept as streaming state per group."""
    return metrics.confusion_matrix(scored, pred_col, label_col, group_cols)


def keep_score_counts(scored: DataFrame, path: str, score_col: str = "score", label_col: str = "label",
                      group_cols: Sequence[str] = (), checkpoint: str | None = None,
                      trigger_once: bool = False) -> StreamingQuery:
    """Keep positives and negatives per (group, score) of a stream as a table under ``path``.

    A micro-batch writes the counts so far into a folder of its own number, so a batch that
    is repeated after a failure writes the same folder again; the two newest folders stay.
    With the same ``checkpoint`` a restarted query goes on from its state."""
    spark = scored.sparkSession
    counts = metrics.score_counts(scored, score_col, label_col, group_cols)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old, _ in _batches(batch.sparkSession, path)[:-2]:
            where, fs = _folder(batch.sparkSession, f"{path}/batch={old}")
            fs.delete(where, True)
    w = (counts.writeStream.outputMode("complete").foreachBatch(put)
         .option("checkpointLocation", checkpoint or shared_dir(spark, "stream", "score-counts")))
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def auroc_now(spark: SparkSession, path: str, score_col: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact AUROC per group over the rows that ``keep_score_counts`` has seen."""
    done = [n for n, complete in _batches(spark, path) if complete]
    if not done:
        raise ValueError(f"no micro-batch has been written under {path}")
    counts = spark.read.parquet(f"{path}/batch={done[-1]}")
    return metrics.auroc_from_counts(counts, score_col, group_cols)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Numbers of the written micro-batches, ascending, and whether each is complete."""
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=")]
    return sorted((int(p.getName().split("=")[1]), fs.exists(_folder(spark, f"{p.toString()}/_SUCCESS")[0]))
                  for p in names)


def start(df: DataFrame, name: str, sink: str, output_mode: str = "complete",
          path: str | None = None, checkpoint: str | None = None,
          trigger_once: bool = False) -> StreamingQuery:
    """Start a streaming query with its checkpoint under the shared folder.

    ``sink`` has no default: ``memory`` keeps every row on the driver and suits
    the few rows of a complete-mode aggregate only."""
    spark = df.sparkSession
    checkpoint = checkpoint or shared_dir(spark, "stream", name)
    w = (df.writeStream.queryName(name).outputMode(output_mode).format(sink)
         .option("checkpointLocation", checkpoint))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start(path) if path else w.start()

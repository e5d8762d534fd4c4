"""Token ids in ORC files.

One row per document: ``part, doc_id, pos, n_tokens, ids``. Files hold ranges of
doc_id in ascending order, one file per range; inside a file rows ascend too, so
stripe and row-group statistics on doc_id are narrow and a lookup skips all
other stripes. The id lists are ORC integer columns (run-length encoded), row
groups carry indexes, and doc_id carries a Bloom filter for point lookups.
Stripes are read in parallel: Spark splits files at stripe bounds.

``pos`` counts the ids before the document in its file; ``read`` adds the ids of
the files before it (a table of one row per file), which gives ``start``.

A null text is empty: it has the end id only. Repeated rows of one doc_id stay,
ordered by a hash of the text. Rows without a doc_id are left out; other
columns are not read. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch
from cohortlab.llm.encoding import ALONE_BYTES, VOCABULARY, encoder, slices

SCHEMA = "part int, doc_id bigint, pos bigint, n_tokens int, ids array<int>"
OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
           "orc.row.index.stride": "1000", "orc.stripe.size": str(32 * 1024 * 1024)}


def _encode(batches: Iterator[pd.DataFrame], vocabulary: str, end_id: int) -> Iterator[pd.DataFrame]:
    enc, part, pos = encoder(vocabulary, table_bytes=ALONE_BYTES), TaskContext.get().partitionId(), 0
    for batch in batches:
        for pdf in slices(batch):
            ids = [np.append(np.frombuffer(b, dtype=enc.dtype).astype(np.int32), np.int32(end_id))
                   for b in enc.encode(pdf["text"].tolist())]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            yield pd.DataFrame({"part": part, "doc_id": pdf["doc_id"].to_numpy(),
                                "pos": pos + np.cumsum(n) - n, "n_tokens": n, "ids": ids})
            pos += int(n.sum())


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str = VOCABULARY,
          files: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the ORC files in ascending doc_id order."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    (src.repartitionByRange(files, *order).sortWithinPartitions(*order)
     .mapInPandas(lambda it: _encode(it, vocabulary, end_id), SCHEMA)
     .write.format("orc").options(**OPTIONS).save(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of written files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    files = rows.groupBy("part").agg(F.max(F.col("pos") + F.col("n_tokens")).alias("n"))
    # one row per file that was written
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("pos")).alias("start"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of some documents; stripe statistics and Bloom filters prune the rest."""
    return (spark.read.schema(SCHEMA).orc(path)
            .filter(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "ids"))


def _crc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="ids").assign(
            ids_crc32=[zlib.crc32(np.asarray(x, dtype="<u4").tobytes()) for x in pdf["ids"]])


def digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows from ``read``."""
    return tokens.mapInPandas(_crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write ``docs`` to the shared folder, read the files back and digest them."""
    spark = docs.sparkSession
    path = Scratch(spark, "token-orc").path("tokens")
    write(docs, path, end_id, vocabulary)
    return digest(read(spark, path))

"""Broadcast behind a size check.

A side is broadcast only after its size has been measured: the frame is
checkpointed to the shared folder (so the count and the join read the same
materialised rows, and an executor loss does not recompute it), its rows are
counted, and its bytes are measured as the length of each row written as JSON
(nested strings, arrays and maps at their real lengths).
Only a frame within both ``max_rows`` and the session's broadcast threshold
(``spark.sql.autoBroadcastJoinThreshold``; -1 disables broadcasting) gets the
hint. A larger one is returned plain, so Spark plans a shuffle join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import qcol
from cohortlab.session import ensure_checkpoint_dir

DEFAULT_MAX_ROWS = 200_000
DEFAULT_THRESHOLD = 10 * 1024 * 1024

_UNITS = {"b": 1, "k": 1024, "kb": 1024, "m": 1024 ** 2, "mb": 1024 ** 2,
          "g": 1024 ** 3, "gb": 1024 ** 3, "t": 1024 ** 4, "tb": 1024 ** 4}


def _parse_bytes(v: str | None) -> int:
    if v is None:
        return DEFAULT_THRESHOLD
    m = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", str(v))
    if not m:
        return DEFAULT_THRESHOLD
    n, unit = int(m.group(1)), m.group(2).lower() or "b"
    return n if n < 0 else n * _UNITS.get(unit, 1)


def broadcast_threshold(spark) -> int:
    return _parse_bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None))


def row_width(df: DataFrame) -> int:
    """Spark's default-size estimate of one row of ``df`` (bytes)."""
    try:
        jvm = df.sparkSession._jvm
        return int(jvm.org.apache.spark.sql.types.DataType.fromJson(df.schema.json())
                   .defaultSize())
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. a remote session)
        return 8 + 16 * len(df.schema.fields)


def measured(small: DataFrame) -> tuple[DataFrame, int, int]:
    """Checkpoint ``small`` into the shared folder; return it, its row count
    and its size in bytes, from one pass over the checkpoint. The size is the
    length of each row written as JSON, which counts nested strings, arrays
    and maps at their real lengths."""
    ensure_checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    row_json = F.to_json(F.struct(*[qcol(c) for c in small.columns])) if small.columns \
        else F.lit("")
    r = small.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.octet_length(row_json)).alias("b")).first()
    return small, int(r["n"]), int(r["b"] or 0)


def fits_broadcast(df: DataFrame, n_rows: int, max_rows: int = DEFAULT_MAX_ROWS,
                   n_bytes: int | None = None) -> bool:
    limit = broadcast_threshold(df.sparkSession)
    size = n_bytes if n_bytes is not None else n_rows * row_width(df)
    return limit >= 0 and n_rows <= max_rows and size <= limit


def bounded_broadcast(small: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    if small.isStreaming:
        return small
    small, n, size = measured(small)
    return F.broadcast(small) if fits_broadcast(small, n, max_rows, size) else small

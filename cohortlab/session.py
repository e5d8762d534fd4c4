"""Session set-up and the shared folder for lineage cuts.

The library never picks a machine-local folder on a cluster: written tables and
checkpoints go under the folder the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent (a bare local session, as in tests) does the
library make a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN_DIRS: dict[int, str] = {}


def cluster_settings(input_bytes: int, total_cores: int,
                     partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    Scan splits target ``partition_bytes`` each, so a task's working set fits
    an executor core's memory share and spills little. Shuffles start with at
    least two partitions per core and at most ``shuffle_bytes`` of input per
    partition (a full-data shuffle then stays within about that per task);
    AQE merges the small partitions of light shuffles (aggregates of a few
    groups) and splits skewed join partitions at run time.
    """
    shuffle_bytes = 2 * 1024 ** 3
    parts = max(2 * total_cores, -(-int(input_bytes) // shuffle_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.requireAllClusterKeysForCoPartition": "false",  # joins of ``align.ranked_tables``
        **lookup_settings(),
    }


def lookup_settings(n_keys: int = 16_000_000, key_bytes: int = 1024 ** 3) -> dict[str, str]:
    """Spark's runtime Bloom filter for lookups of more keys than a broadcast holds: built from
    up to ``key_bytes`` of keys, with eight bits for each of ``n_keys`` (two in a hundred other rows
    pass; 16 MB by default, which also bounds it). More keys let more rows pass, none is lost."""
    name = "spark.sql.optimizer.runtime.bloomFilter"
    return {
        f"{name}.enabled": "true",
        f"{name}.creationSideThreshold": str(key_bytes),
        f"{name}.expectedNumItems": str(n_keys),
        f"{name}.maxNumItems": str(n_keys),
        f"{name}.numBits": str(8 * n_keys),
        f"{name}.maxNumBits": str(8 * n_keys),
    }


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "cohortlab", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's session."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only where none is set."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server's folder applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster, set it to a folder "
                           "all executors share (the library never falls back to a local one)")
    own = _OWN_DIRS.get(id(sc))
    if own is None:
        own = tempfile.mkdtemp(prefix="cohortlab-ckpt-")
        _OWN_DIRS[id(sc)] = own
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir() or own


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh path (not yet created) under the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    name = "-".join(parts) if parts else "table"
    return f"{base.rstrip('/')}/cohortlab/{name}-{uuid.uuid4().hex}"

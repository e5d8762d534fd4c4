"""Fits kept in the shared folder.

A fit is written once by its own writer, under a key of what it was fitted on (table state,
settings); every later session with the same key reads it and fits nothing. A fit is
written beside its place and renamed into it, so a session that is lost half-way leaves no
half fit, and of two sessions that fit at once one result stays. Fits of a slot under other
keys (a rewritten table, other settings) are removed when a new one is in place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from cohortlab.session import ensure_checkpoint_dir


def base_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/cohortlab/fits"


def kept(spark: SparkSession, slot: str, state: Any, fit: Callable[[], Any],
         save: Callable[[Any, str], None], load: Callable[[str], Any], base: str | None = None) -> Any:
    """The fit of ``slot`` for ``state``: read if it is there, else made, written and read."""
    folder = f"{base or base_dir(spark)}/{slot}"
    key = hashlib.sha256(repr(state).encode()).hexdigest()[:24]
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    place = path_of(f"{folder}/{key}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        beside = f"{folder}/{key}-{uuid.uuid4().hex}"
        save(fit(), beside)
        if fs.exists(place) or not fs.rename(path_of(beside), place):
            fs.delete(path_of(beside), True)               # another session was first
        for other in fs.listStatus(path_of(folder)):
            name = other.getPath().getName()
            if name != key and "-" not in name:
                fs.delete(other.getPath(), True)
    return load(place.toString())

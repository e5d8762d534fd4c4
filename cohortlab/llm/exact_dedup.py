"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when identical after each run of white space ``[\\x20\\x09-\\x0D]+``
becomes one space (a null text is empty). The pseudo-key of a text is the
64-bit hash of the normalised text.

*   Directory: the distinct pseudo-keys are counted per 16-bit prefix (at most
    65,536 counts reach the driver). Starting from one bucket, the directory
    doubles while a bucket holds more keys than its capacity; a split touches
    that bucket only. Its depth ends at the 16 bits counted, so the directory
    stays small; a bucket beyond its capacity there is still right, as owners
    stream sorted rows and hold one chain at a time.
*   Every scan task first chains equal texts among its own rows, so a text held
    by a third of all rows leaves each task once.
*   Rows go to owner tasks by contiguous bucket ranges, cut so that the counted
    bytes of the distinct texts are shared out evenly; a task has one owner. An owner walks its
    rows in key order; rows of one pseudo-key form a chain whose texts are
    compared byte by byte, so two texts with the same key stay apart.
*   Owners write the index to the shared folder; every document then reads its
    chain's entry.

The smallest doc_id of equal texts stays. Rows without a doc_id have no name to
report and are left out; repeated rows of one doc_id and text share their
decision and count in ``group_size``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch

PREFIX_BITS = 16
#: Distinct keys that a bucket holds before it splits.
BUCKET_KEYS = 4096
#: Text bytes that a scan task chains before it sends what it has.
LOCAL_BYTES = 32 * 1024 * 1024

_ENTRY = "owner int, bucket int, key bigint, text_sha256 string, norm string, keep_id bigint, n bigint"
_INDEX = "bucket int, key bigint, chain int, text_sha256 string, keep_id bigint, group_size bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Directory:
    """Extendible-hash directory over the top bits of a 64-bit key."""

    def __init__(self, counts: np.ndarray, capacity: int = BUCKET_KEYS):
        """``counts``: keys per prefix of ``PREFIX_BITS`` bits, in prefix order."""
        bits = int(counts.size).bit_length() - 1
        total = np.concatenate([[0], np.cumsum(counts)])
        self.depth = 0                       # global depth: the directory has 2**depth slots
        self.slots = [0]                     # slot -> bucket
        buckets = [(0, 0)]                   # bucket -> (prefix, local depth)
        todo = [0]
        while todo:
            b = todo.pop()
            prefix, local = buckets[b]
            span = 1 << (bits - local)
            if local == bits or total[(prefix + 1) * span] - total[prefix * span] <= capacity:
                continue
            if local == self.depth:          # no slot bit left for this bucket: double
                self.slots = [s for s in self.slots for _ in (0, 1)]
                self.depth += 1
            new = len(buckets)
            buckets[b] = (2 * prefix, local + 1)
            buckets.append((2 * prefix + 1, local + 1))
            width = 1 << (self.depth - local - 1)
            at = (2 * prefix + 1) * width
            self.slots[at:at + width] = [new] * width
            todo += [b, new]
        # bucket numbers follow key order, so a range of them is a key range
        order = {b: i for i, b in enumerate(dict.fromkeys(self.slots))}
        self.bucket_of_slot = np.array([order[s] for s in self.slots], dtype=np.int64)
        self.n_buckets = len(order)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        u = keys.astype(np.int64).view(np.uint64)
        slot = (u >> np.uint64(64 - self.depth)) if self.depth else np.zeros(len(u), np.uint64)
        return self.bucket_of_slot[slot.astype(np.int64)]


def owners(directory: Directory, sizes: np.ndarray, n: int) -> np.ndarray:
    """Bucket -> owner: ``n`` runs of buckets with about equal shares of ``sizes``, the bytes per
    prefix. A bucket belongs to the share that its middle byte lies in."""
    prefix = np.arange(sizes.size)
    bits = int(sizes.size).bit_length() - 1
    bucket = directory.bucket_of_slot[prefix >> (bits - directory.depth)]
    per = np.bincount(bucket, weights=sizes, minlength=directory.n_buckets)
    middle = np.cumsum(per) - per / 2
    return np.minimum(middle * n // max(per.sum(), 1), n - 1).astype(np.int64)


def _chain(batches: Iterator[pd.DataFrame], directory: Directory, owner: np.ndarray,
           flush: int) -> Iterator[pd.DataFrame]:
    """Equal texts of a task's own rows become one entry each."""
    chains: dict[int, list[list]] = {}
    held = 0

    def out() -> pd.DataFrame:
        rows = [(k, *e) for k, c in chains.items() for e in c]
        pdf = pd.DataFrame(rows, columns=["key", "norm", "text_sha256", "keep_id", "n"])
        pdf["bucket"] = directory.bucket(pdf["key"].to_numpy(dtype=np.int64))
        pdf["owner"] = owner[pdf["bucket"].to_numpy(dtype=np.int64)]
        return pdf[["owner", "bucket", "key", "text_sha256", "norm", "keep_id", "n"]]

    for pdf in batches:
        for i, k, t, h in zip(pdf["doc_id"], pdf["key"], pdf["norm"], pdf["text_sha256"], strict=True):
            c = chains.setdefault(k, [])
            e = next((e for e in c if e[0] == t), None)
            if e is None:
                c.append([t, h, i, 1])
                held += len(t)
            else:
                e[2], e[3] = min(e[2], i), e[3] + 1
        if held >= flush:
            yield out()
            chains, held = {}, 0
    if chains:
        yield out()


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive in key order: one chain at a time, texts compared byte by byte."""
    key, bucket, chain = None, 0, []

    def close() -> list[tuple]:
        return [(bucket, key, j, h, i, n) for j, (_, h, i, n) in enumerate(chain)]

    cols = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size"]
    for pdf in batches:
        done: list[tuple] = []
        for b, k, h, t, i, n in zip(pdf["bucket"], pdf["key"], pdf["text_sha256"], pdf["norm"],
                                    pdf["keep_id"], pdf["n"], strict=True):
            if k != key:
                done += close()
                key, bucket, chain = k, b, []
            e = next((e for e in chain if e[0] == t), None)
            if e is None:
                chain.append([t, h, i, n])
            else:
                e[2], e[3] = min(e[2], i), e[3] + n
        if done:
            yield pd.DataFrame(done, columns=cols)
    if chain:
        yield pd.DataFrame(close(), columns=cols)


def build_index(docs: DataFrame, scratch: Scratch, capacity: int = BUCKET_KEYS,
                local_bytes: int = LOCAL_BYTES) -> tuple[DataFrame, DataFrame, Directory]:
    """(entries per document, index of distinct texts, directory), both tables on shared files."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        normalised(F.col("text").cast("string")).alias("norm"))
    entries = scratch.put("entries", rows.select(
        "doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256"),
        F.octet_length("norm").alias("size")))
    prefix = F.shiftrightunsigned("key", 64 - PREFIX_BITS).cast("int")
    counts = np.zeros(1 << PREFIX_BITS, dtype=np.int64)
    sizes = np.zeros(1 << PREFIX_BITS)
    per_key = entries.groupBy("key").agg(F.max("size").cast("double").alias("size"))
    for p, n, b in per_key.groupBy(prefix.alias("p")).agg(F.count("key"), F.sum("size")).collect():
        counts[p], sizes[p] = n, b         # at most 2**PREFIX_BITS rows
    directory = Directory(counts, capacity)
    n_owners = min(directory.n_buckets, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    owner = owners(directory, sizes, n_owners)
    keyed = rows.select("doc_id", "norm", F.xxhash64("norm").alias("key"),
                        F.sha2("norm", 256).alias("text_sha256"))
    local = keyed.mapInPandas(lambda it: _chain(it, directory, owner, local_bytes), _ENTRY)
    index = scratch.put("index", local.repartitionById(n_owners, "owner")
                        .sortWithinPartitions("key", "keep_id").drop("owner")
                        .mapInPandas(_own, _INDEX))
    return entries, index, directory


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every document."""
    entries, index, _ = build_index(docs, Scratch(docs.sparkSession, "exact-dedup"), capacity)
    return entries.join(index.select("key", "text_sha256", "keep_id", "group_size"),
                        ["key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        "text_sha256")

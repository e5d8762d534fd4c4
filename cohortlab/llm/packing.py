"""Packing documents into token sequences by lexical retrieval.

1.  Every text is encoded once. Its full windows of ``size`` ids are sequences
    of their own; what is left of each document (its tail, under ``size`` ids) is
    written with the ids.
2.  Document frequencies of all tails are counted (one row per token id).
3.  Tails are range-partitioned into shards of about ``shard_docs`` by their
    rarest token (the largest id: byte-pair ids ascend as merges get rarer) and
    doc_id, so related tails share a shard and a token that a third of all tails
    share is still cut by doc_id. Each shard builds a BM25 inverted index of its
    tails with the corpus-wide frequencies.
4.  The longest unused tail is the seed of a window; the index ranks its unused
    neighbours in the shard by all tokens of the seed, and they fill the window
    in that order while they fit. The best neighbour left is cut to the room that
    remains and its rest goes back; with no neighbour left, the next unused tail
    serves. So all windows of a shard but the last are full.

Cut places are free and every id lies in exactly one piece. A null or empty text
has the end id only. Repeated rows are packed as documents of their own; rows
without a doc_id are left out. Other columns are not read; an empty table gives
no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch
from cohortlab.llm.encoding import TABLE_BYTES, VOCABULARY, encoder, slices

SIZE = 1024
SHARD_DOCS = 4000
K1, B = 1.2, 0.75

_ENCODED = ("doc_id bigint, doc_tokens bigint, heads array<bigint>, rare int, tail_start bigint, "
            "tail binary")
_PIECE = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encode(batches: Iterator[pd.DataFrame], size: int, end_id: int, vocabulary: str,
            table_bytes: int) -> Iterator[pd.DataFrame]:
    enc = encoder(vocabulary, table_bytes=table_bytes)
    end = np.array([end_id], dtype=enc.dtype)
    for batch in batches:
        for pdf in slices(batch):
            rows = []
            for i, raw in zip(pdf["doc_id"], enc.encode(pdf["text"].tolist()), strict=True):
                ids = np.concatenate([np.frombuffer(raw, dtype=enc.dtype), end])
                cut = len(ids) // size * size
                heads = [_crc(ids[k:k + size]) for k in range(0, cut, size)]
                tail = ids[cut:]
                rows.append((i, len(ids), heads, int(tail.max()) if len(tail) else -1, cut,
                             tail.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "heads", "rare", "tail_start", "tail"])


def _frequencies(batches: Iterator[pd.DataFrame], dtype: str) -> Iterator[pd.DataFrame]:
    df: np.ndarray = np.zeros(0, dtype=np.int64)
    for pdf in batches:
        for raw in pdf["tail"]:
            u = np.unique(np.frombuffer(raw, dtype=dtype))
            if len(u) and u[-1] >= len(df):
                df = np.concatenate([df, np.zeros(int(u[-1]) + 1 - len(df), dtype=np.int64)])
            df[u] += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"token": at, "df": df[at]})


class Shard:
    """BM25 inverted index over the tails of one shard, and its greedy packing."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.tails = tails
        self.n = len(tails)
        tok, doc, weight, self.query = [], [], [], []
        for i, t in enumerate(tails):
            u, tf = np.unique(t, return_counts=True)
            w = idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean_length))
            tok.append(u.astype(np.int64))
            doc.append(np.full(len(u), i, dtype=np.int64))
            weight.append(w)
            self.query.append(tok[-1])
        token = np.concatenate(tok)
        order = np.argsort(token, kind="stable")
        self.doc, self.weight = np.concatenate(doc)[order], np.concatenate(weight)[order]
        self.first = np.searchsorted(token[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused tails that share a token with the seed, best first."""
        q = self.query[seed]
        spans = [slice(a, z) for a, z in zip(self.first[q].tolist(), self.first[q + 1].tolist(), strict=True)]
        doc, weight = (np.concatenate([x[k] for k in spans]) for x in (self.doc, self.weight))
        score = np.bincount(doc, weight, minlength=self.n)
        score[used] = 0.0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def shrink(self, used: np.ndarray) -> None:
        """Leave out the postings of used tails."""
        keep = ~used[self.doc]
        self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]
        self.doc, self.weight = self.doc[keep], self.weight[keep]

    def pack(self, size: int) -> list[list[tuple[int, int, int]]]:
        """Windows of pieces (tail, start in the tail, length)."""
        left = np.array([len(t) for t in self.tails])
        begin = np.zeros(self.n, dtype=np.int64)
        used = left == 0
        order = np.argsort(-left, kind="stable")
        windows, at, held = [], 0, self.n
        while True:
            while at < self.n and used[order[at]]:
                at += 1
            if at == self.n:
                return windows
            if 4 * np.count_nonzero(~used) <= 3 * held:
                held = np.count_nonzero(~used)
                self.shrink(used)
            seed = order[at]
            window, room = [], size

            def place(i: int, n: int) -> None:
                nonlocal room
                window.append((int(i), int(begin[i]), int(n)))
                begin[i] += n
                left[i] -= n
                used[i] = left[i] == 0
                room -= int(n)

            place(seed, min(left[seed], room))
            near = self.neighbours(seed, used) if room else np.empty(0, dtype=np.int64)
            fits = near
            while room and len(fits := fits[left[fits] <= room]):
                place(fits[0], left[fits[0]])
                fits = fits[1:]
            rest = iter(near)
            nxt = at
            while room:                    # cut the best one left, or the next in line
                i = next((j for j in rest if not used[j]), None)
                while i is None and nxt < self.n:
                    if not used[order[nxt]]:
                        i = order[nxt]
                    nxt += 1
                if i is None:
                    break
                place(i, min(left[i], room))
            windows.append(window)


def _pack(batches: Iterator[pd.DataFrame], size: int, idf: np.ndarray, mean: float,
          dtype: str) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(batches), ignore_index=True)     # one shard
    if not len(pdf):
        return
    tails = [np.frombuffer(x, dtype=dtype) for x in pdf["tail"]]
    part, rows = TaskContext.get().partitionId(), []
    ids, total, base = (pdf[c].tolist() for c in ("doc_id", "doc_tokens", "tail_start"))
    for k, window in enumerate(Shard(tails, idf, mean).pack(size)):
        at = 0
        for i, s, n in window:
            rows.append((ids[i], base[i] + s, n, _crc(tails[i][s:s + n]), total[i],
                         2 * ((part << 31) + k) + 1, at))
            at += n
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECE.split(", ")])


def pack(docs: DataFrame, size: int = SIZE, end_id: int = 0, vocabulary: str = VOCABULARY,
         shard_docs: int = SHARD_DOCS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Odd sequence ids are packed windows, even ones full windows of one document."""
    spark = docs.sparkSession
    sc = Scratch(spark, "packing")
    dtype = encoder(vocabulary).dtype.str
    src = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    enc = sc.put("encoded", src.mapInPandas(lambda it: _encode(it, size, end_id, vocabulary, table_bytes), _ENCODED),
                 compression="zstd")
    tails = enc.filter("rare >= 0").select("doc_id", "doc_tokens", "rare", "tail_start", "tail")
    n, mean = tails.agg(F.count(F.lit(1)), F.avg(F.octet_length("tail"))).first()
    size_ = F.lit(size).cast("bigint")
    heads = (enc.filter(F.size("heads") > 0).select("doc_id", "doc_tokens", F.posexplode("heads"))
             .select("doc_id", (F.col("pos") * size_).alias("start"), size_.alias("length"),
                     F.col("col").alias("ids_crc32"), "doc_tokens",
                     (F.monotonically_increasing_id() * 2).alias("sequence_id"),
                     F.lit(0).cast("bigint").alias("offset")))
    if not n:
        return heads
    df = (tails.select("tail").mapInPandas(lambda it: _frequencies(it, dtype), "token int, df bigint")
          .groupBy("token").agg(F.sum("df").alias("df")).collect())     # one row per token id
    idf = np.zeros(max(r["token"] for r in df) + 1)
    for r in df:
        idf[r["token"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    mean /= np.dtype(dtype).itemsize
    shards = -(-n // shard_docs)
    packed = (tails.repartitionByRange(shards, "rare", "doc_id", "tail_start")
              .sortWithinPartitions("doc_id", "tail")
              .mapInPandas(lambda it: _pack(it, size, idf, mean, dtype), _PIECE))
    return heads.unionByName(packed)

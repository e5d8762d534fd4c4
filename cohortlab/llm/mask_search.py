"""Ranked lexical search by presence-mask grouping.

1.  The items' terms are made into a dictionary. Items are dealt into blocks whose
    dictionary stays within ``BLOCK_BYTES`` and the steps below run once a block, so
    what is broadcast is bounded however many items there are.
2.  One pass over the whole texts writes each document's term count and its item
    terms with their frequencies. N, L and df are counted over that table.
3.  Each task takes batches of documents. For an item, the documents of a batch get
    a bitmap of the item's terms that they hold (one bit a term) and are grouped by
    it. A mask's maximum score adds up the highest contribution that each of its
    terms has in the batch. Masks are evaluated by descending maximum, all documents
    of a mask at once, until the maximum falls below the item's k-th best score so
    far; equal maxima are still evaluated, since ties go to the smaller doc_id.
4.  A task returns at most k rows an item; a window merges them.

Terms, weights and scores are those of the contract: ASCII letters lower-cased,
letters, digits and all non-ASCII characters form terms; integer arithmetic.
Null and empty texts hold no term. Rows of one item_id are one item with all their
terms; repeated rows of a doc_id are documents of their own. Rows without an id are
left out. Other columns are not read; empty tables give no row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch

#: Bytes of a block's dictionary as Python holds it (a term counts its bytes and TERM_BYTES).
BLOCK_BYTES = 32 * 1024 * 1024
TERM_BYTES = 120
#: Documents evaluated at a time, at first; doubled while an item is not finished.
FIRST_DOCS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes((b | 32) if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_HELD = "doc_id bigint, n bigint, terms binary, tfs binary"
_HITS = "item int, doc_id bigint, score bigint"


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, with repeats."""
    return text.encode().translate(_TABLE).split() if text else []


def term_column(text: Column) -> Column:
    """The same as an expression: distinct terms of a text."""
    low = F.translate(text.cast("string"), _UPPER, _LOWER)
    return F.array_distinct(F.filter(F.split(low, _NOT_TERM), lambda x: x != ""))


def _held(batches: Iterator[pd.DataFrame], ids: dict[bytes, int]) -> Iterator[pd.DataFrame]:
    """Term count and item terms of each document that holds any term."""
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            words = terms(text)
            if words:
                found = Counter(w for w in map(ids.get, words) if w is not None)
                t = np.fromiter(found.keys(), dtype="<u4", count=len(found))
                f = np.fromiter(found.values(), dtype="<u4", count=len(found))
                rows.append((doc_id, len(words), t.tobytes(), f.tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"])


def _frequencies(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    df = np.zeros(size, dtype=np.int64)
    for pdf in batches:
        if len(pdf):
            df += np.bincount(np.concatenate([np.frombuffer(b, dtype="<u4") for b in pdf["terms"]]),
                              minlength=size)
    at = np.flatnonzero(df)
    yield pd.DataFrame({"term": at, "df": df[at]})


class Batch:
    """Postings of a batch of documents and the grouping of its documents by mask."""

    def __init__(self, pdf: pd.DataFrame, weight: np.ndarray, n_docs: int, total: int):
        self.doc_ids = pdf["doc_id"].to_numpy(np.int64)
        held = [np.frombuffer(b, dtype="<u4") for b in pdf["terms"]]
        term = np.concatenate(held).astype(np.int64)
        doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
        tf = np.concatenate([np.frombuffer(b, dtype="<u4") for b in pdf["tfs"]]).astype(np.int64)
        m = 100 - 90 + (90 * pdf["n"].to_numpy(np.int64) * n_docs) // total
        order = np.argsort(term, kind="stable")
        self.term, self.doc = term[order], doc[order]
        tf = tf[order]
        self.part = weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.names, self.first = np.unique(self.term, return_index=True)
        self.last = np.append(self.first[1:], len(self.term))
        self.highest = (np.maximum.reduceat(self.part, self.first) if len(self.first)
                        else np.zeros(0, dtype=np.int64))

    def postings(self, item: np.ndarray) -> list[tuple[slice, int]]:
        """Slices and highest contributions of an item's terms that the batch holds."""
        at = np.searchsorted(self.names, item)
        at = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == item)] \
            if len(self.names) else at[:0]
        return [(slice(int(self.first[a]), int(self.last[a])), int(self.highest[a])) for a in at
                if self.highest[a] > 0]

    def masks(self, held: list[tuple[slice, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Maximum score of each distinct mask, and each document's mask number."""
        words = -(-len(held) // 64)
        bits = np.zeros((len(self.doc_ids), words), dtype=np.uint64)
        for j, (s, _) in enumerate(held):
            bits[self.doc[s], j >> 6] |= np.uint64(1 << (j & 63))
        if words == 1:
            distinct, number = np.unique(bits[:, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, number = np.unique(bits, axis=0, return_inverse=True)
        most = np.zeros(len(distinct), dtype=np.int64)
        for j, (_, high) in enumerate(held):
            most += np.where(distinct[:, j >> 6] >> np.uint64(j & 63) & np.uint64(1), high, 0)
        return most, number.ravel()

    def scores(self, held: list[tuple[slice, int]], docs: np.ndarray) -> np.ndarray:
        """Scores of some documents, given in ascending order."""
        out = np.zeros(len(docs), dtype=np.int64)
        for s, _ in held:
            here = self.doc[s]
            at = np.minimum(np.searchsorted(here, docs), len(here) - 1)
            out += np.where(here[at] == docs, self.part[s][at], 0)
        return out

    def search(self, item: np.ndarray, heap: list[tuple[int, int]], k: int) -> int:
        """Keep the item's k best (score, -doc_id) in ``heap``; how many were evaluated."""
        held = self.postings(item)
        if not held:
            return 0
        most, number = self.masks(held)
        by_most = np.argsort(-most, kind="stable")
        place = np.empty(len(most), dtype=np.int64)
        place[by_most] = np.arange(len(most))
        docs = np.argsort(place[number], kind="stable")      # documents by descending maximum
        ends = np.cumsum(np.bincount(place[number], minlength=len(most)))
        most, g, at, step = most[by_most], 0, 0, FIRST_DOCS
        while g < len(most) and most[g] > 0 and (len(heap) < k or most[g] >= heap[0][0]):
            g = max(g + 1, int(np.searchsorted(ends, at + step, side="right")))   # whole masks
            here = np.sort(docs[at:ends[g - 1]])
            score = self.scores(held, here)
            keep = score > 0 if len(heap) < k else score >= max(heap[0][0], 1)
            for s, d in zip(score[keep].tolist(), self.doc_ids[here[keep]].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -d))
                elif (s, -d) > heap[0]:
                    heapq.heapreplace(heap, (s, -d))
            at, step = int(ends[g - 1]), 2 * step
        return at


def _rank(batches: Iterator[pd.DataFrame], items: list[np.ndarray], weight: np.ndarray, n_docs: int,
          total: int, k: int) -> Iterator[pd.DataFrame]:
    heaps: list[list[tuple[int, int]]] = [[] for _ in items]
    for pdf in batches:
        if len(pdf):
            batch = Batch(pdf, weight, n_docs, total)
            for item, heap in zip(items, heaps, strict=True):
                batch.search(item, heap, k)
    yield pd.DataFrame([(i, -d, s) for i, heap in enumerate(heaps) for s, d in heap],
                       columns=["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of each item."""
    spark = docs.sparkSession
    sc = Scratch(spark, "mask-search")
    src = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = sc.put("terms", items.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"), F.explode(term_column(F.col("text"))).alias("term")).distinct())
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + TERM_BYTES), F.lit(0))).first()[0]
    blocks = -(-int(size) // block_bytes)
    out = None
    for b in range(blocks):
        found = _block(sc, src, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, b)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out


def _block(sc: Scratch, src: DataFrame, asked: DataFrame, k: int, number: int) -> DataFrame:
    """The search for the items of one block, whose terms fit the driver and the workers."""
    spark = sc.spark
    pairs = asked.toPandas()                                  # bounded by the block
    words = sorted(set(pairs["term"]))
    ids = {w.encode(): i for i, w in enumerate(words)}
    pairs["t"] = [ids[w.encode()] for w in pairs["term"]]
    grouped = pairs.sort_values(["item_id", "t"]).groupby("item_id")["t"]
    names = [int(i) for i, _ in grouped]
    wanted = [g.to_numpy(np.int64) for _, g in grouped]
    shared = spark.sparkContext.broadcast(ids)
    held = sc.put(f"held-{number}", src.mapInPandas(lambda it: _held(it, shared.value), _HELD), compression="zstd")
    n_docs, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(words)
    df = (held.select("terms").mapInPandas(lambda it: _frequencies(it, size), "term int, df bigint")
          .groupBy("term").agg(F.sum("df").alias("df")).collect())      # one row per term of the block
    weight = np.zeros(size, dtype=np.int64)
    for r in df:
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    plan = spark.sparkContext.broadcast((wanted, weight))
    hits = held.mapInPandas(lambda it: _rank(it, *plan.value, n_docs, total, k), _HITS)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    item = F.broadcast(spark.createDataFrame(list(enumerate(names)), "item int, item_id bigint"))
    return best.join(item, "item").select("item_id", "rank", "doc_id", "score")


def oracle_sql(k: int = 10) -> str:
    """DuckDB SQL of the same rows, by scoring every document for every item."""
    def words(col: str) -> str:
        return f"regexp_extract_all(translate(coalesce({col}, ''), '{_UPPER}', '{_LOWER}'), '[^{_NOT_TERM[1:]}')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {words('text')} AS ws FROM documents WHERE doc_id IS NOT NULL),
st AS (SELECT count(*) AS N, CAST(sum(len(ws)) AS BIGINT) AS L FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, st GROUP BY term, N),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ws) * N) // L) AS m FROM d, st WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({words('text')}) AS term FROM benchmark
      WHERE item_id IS NOT NULL)),
s AS (
  SELECT i.item_id, m.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM i JOIN tf ON tf.term = i.term JOIN w ON w.term = i.term JOIN m ON m.r = tf.r
  GROUP BY i.item_id, m.r, m.doc_id),
o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= {k}"""

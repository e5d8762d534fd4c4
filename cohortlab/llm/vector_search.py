"""Nearest vectors by a block matrix join (largest inner product, exact).

1.  Valid vectors are packed into blocks of at most ``BLOCK_ROWS`` rows. Of equal
    vectors in a block only the ``k + 1`` smallest ids are kept: equal scores are
    ordered by id, so no further copy can be among the k nearest of any query.
2.  Query blocks and candidate blocks meet in a grid of cells: query groups of at
    most about ``CELL_BYTES``, candidate blocks dealt over salts, so a cell holds a
    bounded piece of both sides whatever the tables hold. Nothing is broadcast and
    nothing goes through the driver.
3.  A cell multiplies tiles of int8 vectors (one scale a vector). With x = s q + e
    the product of two vectors differs from that of their int8 forms by at most
    ``|sq||e'| + |e||x'|`` (Cauchy-Schwarz on the measured remainders). A pair
    survives unless its upper bound lies below the query's k-th best score so far
    (for a query's first tile: below the k-th best lower bound of the tile).
4.  Survivors are recomputed on the original vectors in double precision, added up
    in component order, and kept in one heap of k a query. The heaps of a query's
    cells are merged by a window over at most k rows a cell.

Vectors that are null, empty, zero or hold a null or non-finite component take no
part, nor do rows without an id. Vectors meet only those of their own length.
Repeated rows of an id are candidates of their own; as a query an id counts once,
with its smallest vector, and no row of its own id is its candidate. Ties go to
the smaller id. Other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
TILE_QUERIES = 1024
#: Vectors of one side in a cell of the grid, in bytes of double precision.
CELL_BYTES = 16 * 1024 * 1024
#: Components up to which products of int8 values add up exactly in float32.
EXACT_DIM = (1 << 24) // (127 * 127)
PAIRS_AT_ONCE = 1 << 16

_BLOCK = "dim int, part int, number int, ids binary, vecs binary"
_FOUND = "query_id bigint, vec_id bigint, score double"


def valid(vec: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _copies(vecs: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of equal vectors the ``most`` smallest ids."""
    same = np.unique(vecs, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    group = same[order]
    first = np.searchsorted(group, group)
    return np.sort(order[np.arange(len(order)) - first < most])


def _pack(batches: Iterator[pd.DataFrame], copies: int | None) -> Iterator[pd.DataFrame]:
    part, number = TaskContext.get().partitionId(), 0
    for pdf in batches:
        for at in range(0, len(pdf), BLOCK_ROWS):
            cut = pdf.iloc[at:at + BLOCK_ROWS]
            size = cut["vec"].map(len).to_numpy()
            rows = []
            for dim in np.unique(size):
                here = cut[size == dim]
                vecs, ids = np.stack(here["vec"].to_list()).astype("<f8"), here["vec_id"].to_numpy("<i8")
                if copies is not None:
                    keep = _copies(vecs, ids, copies)
                    vecs, ids = vecs[keep], ids[keep]
                rows.append((int(dim), part, number, ids.tobytes(), vecs.tobytes()))
                number += 1
            yield pd.DataFrame(rows, columns=["dim", "part", "number", "ids", "vecs"])


def _unpack(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(b, dtype="<i8") for b in pdf["ids"]])
    vecs = np.concatenate([np.frombuffer(b, dtype="<f8") for b in pdf["vecs"]])
    return ids, vecs.reshape(-1, dim)


class Quantised:
    """int8 forms of vectors with their scale and the norms that bound the error."""

    def __init__(self, vecs: np.ndarray):
        self.scale = np.abs(vecs).max(axis=1) / 127
        # a scale below the smallest normal double would not divide well
        self.scale[self.scale < 1e-300] = 1e-300
        self.int8 = np.clip(np.rint(vecs / self.scale[:, None]), -127, 127).astype(np.int8)
        near = self.int8 * self.scale[:, None]
        self.near, self.all = np.linalg.norm(near, axis=1), np.linalg.norm(vecs, axis=1)
        # a little more than measured, for the rounding of the bounds themselves
        self.off = np.linalg.norm(vecs - near, axis=1) * (1 + 1e-9) + 1e-13 * self.all

    def part(self, rows: slice) -> Quantised:
        out = object.__new__(Quantised)
        for name in ("scale", "int8", "near", "all", "off"):
            setattr(out, name, getattr(self, name)[rows])
        return out


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products of all pairs and how far each may be off."""
    dim = q.int8.shape[1]
    product = np.zeros((len(q.int8), len(c.int8)))
    for at in range(0, dim, EXACT_DIM):           # each float32 product is an exact integer
        product += q.int8[:, at:at + EXACT_DIM].astype(np.float32) @ c.int8[:, at:at + EXACT_DIM].astype(np.float32).T
    product *= q.scale[:, None]
    product *= c.scale[None, :]
    off = np.stack([q.near, q.off], axis=1) @ np.stack([c.off, c.all])
    return product, off


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of aligned rows, added up in component order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _cell(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of each query of a cell among the candidates of the cell."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    dim = int(left["dim"].iloc[0])
    qid, qvec = _unpack(left, dim)
    quant = Quantised(qvec)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    floor = np.full(len(qid), -np.inf)            # k-th best score so far
    for _, block in right.sort_values(["part", "number"]).iterrows():
        cid, cvec = _unpack(block.to_frame().T, dim)
        cq = Quantised(cvec)
        for at in range(0, len(qid), TILE_QUERIES):
            rows = slice(at, at + TILE_QUERIES)
            near, off = bounds(quant.part(rows), cq)
            near[qid[rows, None] == cid[None, :]] = -np.inf
            least = floor[rows].copy()
            new = np.flatnonzero(np.isneginf(least))
            if len(new) and len(cid) > k:
                low = near[new] - off[new]
                least[new] = np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k]
            near += off
            alive = (near >= least[:, None]) & (near != -np.inf)
            i, j = np.nonzero(alive)
            for cut in range(0, len(i), PAIRS_AT_ONCE):
                qi, cj = i[cut:cut + PAIRS_AT_ONCE] + at, j[cut:cut + PAIRS_AT_ONCE]
                for r, s, c in zip(qi.tolist(), exact(qvec[qi], cvec[cj]).tolist(), cid[cj].tolist(), strict=True):
                    heap = heaps[r]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -c))
                    elif (s, -c) > heap[0]:
                        heapq.heapreplace(heap, (s, -c))
            for r in np.unique(i + at).tolist():
                if len(heaps[r]) == k:
                    floor[r] = heaps[r][0][0]
    return pd.DataFrame([(q, -c, s) for q, heap in zip(qid.tolist(), heaps, strict=True) for s, c in heap],
                        columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of every row whose id is
    divisible by ``every``, among all rows of another id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("vec")))
    queries = (rows.filter(F.col("vec_id") % every == 0)
               .groupBy("vec_id").agg(F.min("vec").alias("vec")))
    size = F.coalesce(F.sum(F.size("vec")), F.lit(0)) * 8
    bytes_, query_bytes = rows.agg(size, F.coalesce(F.sum(F.when(F.col("vec_id") % every == 0, F.size("vec"))),
                                                    F.lit(0)) * 8).first()
    groups = max(1, -(-int(query_bytes) // CELL_BYTES))
    salts = max(-(-int(bytes_) // CELL_BYTES), -(-spark.sparkContext.defaultParallelism // groups))
    # queries are dealt to their group before they are packed, so a block belongs to one group
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    left = (queries.withColumn("grp", dealt).repartition(groups, "grp")
            .mapInPandas(lambda it: _grouped(it), f"grp int, {_BLOCK}")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    right = (rows.mapInPandas(lambda it: _pack(it, k + 1), _BLOCK)
             .withColumn("salt", F.pmod(F.xxhash64("part", "number"), F.lit(salts)).cast("int"))
             .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    key = ["dim", "grp", "salt"]
    found = (left.groupBy(*key).cogroup(right.groupBy(*key))
             .applyInPandas(lambda a, b: _cell(a, b, k), _FOUND))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of queries, none with queries of two groups."""
    for pdf in batches:
        for grp, here in pdf.groupby("grp"):
            for block in _pack(iter([here]), None):
                yield block.assign(grp=int(grp))[["grp", "dim", "part", "number", "ids", "vecs"]]


def oracle_sql(k: int = 20, every: int = 20) -> str:
    """DuckDB SQL of the same rows, by the plain product of all pairs."""
    return f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec) AS score
  FROM (SELECT vec_id, min(vec) AS vec FROM v WHERE vec_id % {every} = 0 GROUP BY vec_id) q
  JOIN v c ON c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}"""

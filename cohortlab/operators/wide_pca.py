"""Principal components of wide rows by randomised subspace iteration (M4).

Spark's own ``PCA`` builds the d x d covariance on the driver and stops at 65,535 columns.
Here only d x (k + oversample) sketches exist: each pass multiplies the centred rows X with
the current basis and back (``X' X Q``) task by task, and a tree of reductions adds the
sketches up. The basis is orthonormal on the driver, so its d x (k + oversample) doubles are
what must fit there; ``SKETCH_BYTES`` is checked. Passes go on until the leading
eigenvalues settle. Rows are cut into blocks of their non-zero entries (dense rows too) and
persisted, memory then disk, since every pass reads them.

Null vectors are left out. Fewer than two rows, or a constant table, give components of
zero variance.
"""

from __future__ import annotations

import operator
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest sketch, in bytes, that the driver and each task hold a few of.
SKETCH_BYTES = 128 * 1024 * 1024
BLOCK_VALUES = 1 << 20


@dataclass
class Block:
    """Rows of a partition by their non-zero entries."""

    starts: np.ndarray          # first entry of each row, and the end
    column: np.ndarray
    value: np.ndarray

    def times(self, basis: np.ndarray) -> np.ndarray:
        """X Q"""
        out = np.zeros((len(self.starts) - 1, basis.shape[1]))
        size = np.diff(self.starts)
        rows = np.flatnonzero(size)
        if len(rows):
            out[rows] = np.add.reduceat(self.value[:, None] * basis[self.column], self.starts[rows], axis=0)
        return out

    def back(self, y: np.ndarray, into: np.ndarray) -> None:
        """Add X' Y to ``into``."""
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.column, kind="stable")
        column = self.column[order]
        if len(column):
            first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            into[column[first]] += np.add.reduceat(self.value[order, None] * y[row[order]], first, axis=0)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts, held = [], 0
        for kind, idx, val in zip(pdf["type"], pdf["indices"], pdf["values"], strict=True):
            val = np.asarray(val, dtype=float)
            idx = np.flatnonzero(val) if kind else np.asarray(idx, dtype=np.int64)
            val = val[idx] if kind else val
            parts.append((idx, val))
            held += len(val) + 1
            if held >= BLOCK_VALUES:
                yield _frame(parts)
                parts, held = [], 0
        if parts:
            yield _frame(parts)


def _frame(parts: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    starts = np.cumsum([0, *(len(v) for _, v in parts)])
    block = Block(starts, np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))
    return pd.DataFrame({"block": [pickle.dumps(block)]})


@dataclass
class WidePca:
    """``components`` (d x k, first loading positive), ``variances`` and their share of all."""

    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    mean: np.ndarray
    passes: int


def _sum(blocks: RDD, one) -> np.ndarray:
    def add(it: Iterator[Block]) -> Iterator[np.ndarray]:
        total = None
        for b in it:
            got = one(b)
            total = got if total is None else total + got
        if total is not None:
            yield total
    return blocks.mapPartitions(add).treeReduce(operator.add)


def fit_wide_pca(df: DataFrame, k: int, features_col: str = "scaledFeatures", oversample: int = 10,
                 tolerance: float = 1e-12, most_passes: int = 60, seed: int = 12345) -> WidePca:
    """The ``k`` leading components of a vector column of any width."""
    parts = df.filter(F.col(features_col).isNotNull()).select(F.unwrap_udt(features_col).alias("v")) \
        .select("v.type", "v.size", "v.indices", "v.values")
    shape = parts.agg(F.count(F.lit(1)).alias("n"),
                      F.max(F.coalesce("size", F.size("values"))).alias("d")).first()
    n, d = shape["n"], shape["d"] or 0
    width = min(k + oversample, d)
    if d * width * 8 > SKETCH_BYTES:
        raise ValueError(f"a sketch of {d} x {width} doubles is over {SKETCH_BYTES} bytes")
    if n < 2:
        return WidePca(np.eye(d, min(k, d)), np.zeros(min(k, d)), np.zeros(min(k, d)), np.zeros(d), 0)
    blocks = (parts.mapInPandas(_blocks, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
              .persist(StorageLevel.MEMORY_AND_DISK))
    sc = df.sparkSession.sparkContext
    try:
        def moments(b: Block) -> np.ndarray:
            return np.stack([np.bincount(b.column, b.value ** p, minlength=d) for p in (1, 2)])
        total = _sum(blocks, moments)
        mean = total[0] / n
        spread = max(float((total[1] - n * mean * mean).sum()) / (n - 1), 0.0)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
        last, passes = np.zeros(k), 0
        while True:
            shared = sc.broadcast((basis, mean @ basis, mean))

            def sketch(b: Block) -> np.ndarray:
                q, off, mu = shared.value
                y = b.times(q) - off                          # centred rows times the basis
                out = np.zeros_like(q)
                b.back(y, out)
                return out - np.outer(mu, y.sum(axis=0))
            product = _sum(blocks, sketch) / (n - 1)
            shared.unpersist()
            passes += 1
            values, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            top = np.maximum(values[:k], 0.0)
            ready = np.abs(top - last[:len(top)]).max(initial=0.0) <= tolerance * max(top.max(initial=0.0), 1e-300)
            if passes >= most_passes or ready or width == d and passes > 1:
                break
            last, basis = top, np.linalg.qr(product)[0]
    finally:
        blocks.unpersist()
    components = basis @ turn[:, :k]
    first = np.argmax(np.abs(components) > 1e-6, axis=0)
    components *= np.where(components[first, np.arange(components.shape[1])] < 0, -1.0, 1.0)
    return WidePca(components, top, top / spread if spread > 0 else np.zeros_like(top), mean, passes)


def project(df: DataFrame, model: WidePca, features_col: str = "scaledFeatures",
            names: list[str] | None = None) -> DataFrame:
    """``df`` with one column a component: x times the components, uncentred as Spark's."""
    k = model.components.shape[1]
    names = names or [f"PCA_{i + 1}" for i in range(k)]
    v = F.unwrap_udt(features_col)
    shared = df.sparkSession.sparkContext.broadcast(model.components)

    def one(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = np.zeros((len(pdf), k))
            for i, (kind, idx, val) in enumerate(zip(pdf["_type"], pdf["_indices"], pdf["_values"], strict=True)):
                got[i] = np.asarray(val) @ (shared.value if kind else shared.value[np.asarray(idx, dtype=np.int64)])
            rest = pdf.drop(columns=["_type", "_indices", "_values"])
            yield rest.assign(**{n: got[:, j] for j, n in enumerate(names)})
    rest = [c for c in df.columns if c != features_col]
    flat = df.filter(F.col(features_col).isNotNull()).select(*rest, v.alias("_v")).select(
        *rest, F.col("_v.type").alias("_type"), F.col("_v.indices").alias("_indices"), F.col("_v.values").alias("_values"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema),
                        *(f"`{n}` double" for n in names)])
    return flat.mapInPandas(one, schema)

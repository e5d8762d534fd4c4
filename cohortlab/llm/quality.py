"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 < 1 < ... < K-1. One weight vector w over hashed text
tokens is shared by all grades; ordered thresholds t_1 < ... < t_{K-1} cut the
score: P(grade >= k) = sigmoid(w.x - t_k). The expected grade is the sum of these
tails; documents are selected by the tail of the top grade.

Tokens are lower-cased words, runs of symbols and a few shape marks (share of
capitals, of repeated neighbours, ...), each present or not, hashed to 2**24
buckets. The fit runs on a bounded sample of the rated documents
(``sample_rows``, chosen by a hash of the doc_id); its active buckets are those
in at least ``MIN_DOCS`` sampled documents whose presence differs between grades by
``MIN_Z`` standard errors, at most ``max_features``.
The sample is tokenised by all tasks; one task then fits its active buckets
(memory: ``sample_rows`` documents), and the driver receives the weights.

Null and empty texts are scored on their shape marks. Without ratings of two
grades nothing can be learnt: score, grade and probability are null and every
document is kept. A document rated more than once counts with its lowest grade.
Rows without a doc_id are scored too (doc_id null). Repeated rows get equal
scores. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch

SAMPLE_ROWS = 20_000
MAX_FEATURES = 1 << 15
MIN_DOCS = 6
MIN_Z = 4.5
BUCKETS = 1 << 24
L2 = 2.0
FIT_PARTS = 6
_CACHE = 300_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _level(x: float) -> int:
    """Coarse step of a share in [0, 1]."""
    return int(min(x, 1.0) * 8)


def tokens(text: str | None) -> set[str]:
    """Distinct tokens and shape marks of a text."""
    text = text or ""
    t = _TOKEN.findall(text.lower())
    n = max(len(t), 1)
    out = set(t)
    repeats = sum(a == b for a, b in pairwise(t))
    capitals = sum(map(str.isupper, text[:1] + "".join(text.split()))) if text.isupper() else 0
    out.add(f"\x00repeats {_level(repeats / n)}")
    out.add(f"\x00distinct {_level(len(out) / n)}")
    out.add(f"\x00capitals {int(capitals > 0)}")
    out.add(f"\x00length {len(t).bit_length()}")
    return out


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class OrdinalModel:
    weights: dict[int, float]       # bucket -> weight
    thresholds: list[float]         # ascending
    grades: list[int]               # rating values, ascending

    def scorer(self):
        return _Weights(self.weights)


class _Weights(dict):
    """token -> weight, filled on demand and emptied when it grows too large."""

    def __init__(self, by_bucket: dict[int, float]):
        super().__init__()
        self.by_bucket = by_bucket

    def __missing__(self, token: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        w = self[token] = self.by_bucket.get(bucket(token), 0.0)
        return w


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"grade": pdf["grade"],
                            "idx": [sorted({bucket(t) for t in tokens(x)}) for x in pdf["text"]]})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def ordinal_loss(score: np.ndarray, y: np.ndarray, cuts: np.ndarray):
    """Negative log-likelihood, its gradient by score and by cut, over one block.

    ``y`` holds grade numbers 0..K-1, ``cuts`` the K-1 ascending thresholds."""
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    lo, hi = _sigmoid(score - edge[y]), _sigmoid(score - edge[y + 1])   # P(>= y), P(>= y + 1)
    p = np.maximum(lo - hi, 1e-12)
    dlo, dhi = lo * (1 - lo), hi * (1 - hi)
    g_score = -(dlo - dhi) / p
    k = len(cuts)
    g_cut = (np.bincount(np.clip(y - 1, 0, None), np.where(y > 0, dlo / p, 0.0), minlength=k)[:k]
             - np.bincount(np.clip(y, None, k - 1), np.where(y < k, dhi / p, 0.0), minlength=k)[:k])
    return -np.log(p).sum(), g_score, g_cut


def minimise(f, x: np.ndarray, rounds: int = 300, memory: int = 8, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS with step halving; ``f`` returns value and gradient."""
    fx, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alpha = g.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            q -= a * y
            alpha.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.linalg.norm(g), 1.0)
        for (s, y), a in zip(steps, reversed(alpha), strict=True):
            q += (a - y @ q / (s @ y)) * s
        slope, t = -(g @ q), 1.0
        while True:
            nx = x - t * q
            nf, ng = f(nx)
            if nf <= fx + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = nx - x, ng - g
        if s @ y > 1e-10:
            steps = [*steps, (s, y)][-memory:]
        done = abs(fx - nf) <= tol * max(abs(fx), 1.0)
        x, fx, g = nx, nf, ng
        if done:
            break
    return x


def _solve(y: np.ndarray, row: np.ndarray, flat: np.ndarray, std: np.ndarray, cuts0: np.ndarray,
           l2: float) -> np.ndarray:
    """Weights (per standard deviation), first cut and logs of the gaps between cuts.

    ``flat`` holds the active buckets of all documents, ``row`` whose they are."""
    m, f_n = len(y), len(std)
    start = np.concatenate([np.zeros(f_n), cuts0[:1], np.log(np.maximum(np.diff(cuts0), 1e-3))])

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, gaps = x[:f_n] / std, np.exp(x[f_n + 1:])
        cuts = x[f_n] + np.concatenate([[0.0], np.cumsum(gaps)])
        loss, gs, gc = ordinal_loss(np.bincount(row, w[flat], minlength=m), y, cuts)
        tail = np.cumsum(gc[::-1])[::-1]                            # by first cut, then by each gap
        gw = np.bincount(flat, gs[row], minlength=f_n) / std + l2 * x[:f_n]
        return ((loss + 0.5 * l2 * (x[:f_n] @ x[:f_n])) / m,
                np.concatenate([gw, tail[:1], tail[1:] * gaps]) / m)

    return minimise(value, start)


def _active(rows: DataFrame, grades: list[int], share: np.ndarray, max_features: int) -> dict[int, float]:
    """Buckets whose presence differs across a cut between grades by ``MIN_Z``
    standard errors or more, with their share of documents; at most
    ``max_features``, the clearest first."""
    cuts = range(1, len(grades))
    seen = rows.select("grade", F.explode("idx").alias("b")).groupBy("b").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col("grade") >= grades[k]).cast("int")).alias(f"n{k}") for k in cuts])
    z = []
    for k in cuts:
        up, low = share[k:].sum(), share[:k].sum()
        p = F.col("n") / (up + low)
        z.append(F.abs(F.col(f"n{k}") / up - (F.col("n") - F.col(f"n{k}")) / low)
                 / F.sqrt(p * (1 - p + 1e-9) * (1 / up + 1 / low)))
    best = F.greatest(*z) if len(z) > 1 else z[0]
    top = (seen.filter(F.col("n") >= MIN_DOCS).withColumn("z", F.round(best, 6))
           .filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "b").limit(max_features))
    return {r["b"]: r["n"] / share.sum() for r in top.select("b", "n").collect()}


def fit(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS,
        max_features: int = MAX_FEATURES, l2: float = L2) -> OrdinalModel | None:
    """``ratings``: ``doc_id, grade int``. None where there are no two grades."""
    spark = docs.sparkSession
    sc = Scratch(spark, "quality")
    rated = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()) \
        .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = rated.count()
    if not n:
        return None
    # a hash of the id is uniform in [0, 1): about sample_rows rows, the same ones each time
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("rated")), 11) / F.lit(float(1 << 53))
    sample = rated.filter(u < F.lit(sample_rows / n))
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = sc.put("sample", text.join(F.broadcast(sample), "doc_id").repartition(FIT_PARTS)
                  .mapInPandas(_hashed, "grade int, idx array<int>"))
    grades = sorted(r[0] for r in rows.select("grade").distinct().collect())
    if len(grades) < 2:
        sc.drop("sample")
        return None
    share = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    share = np.array([share[g] for g in grades], dtype=float)
    active_share = _active(rows, grades, share, max_features)
    col = {b: i for i, b in enumerate(active_share)}
    # weights are penalised per standard deviation of their token, so a rare telling
    # word is held back no more than a common one
    p = np.array(list(active_share.values()))
    std = np.sqrt(np.maximum(p * (1 - p), 1e-3))

    above = np.cumsum(share[::-1])[::-1][1:] / share.sum()          # P(grade >= k)
    cuts0, f_n = -np.log(above / (1 - above)), len(col)
    number = {g: i for i, g in enumerate(grades)}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, rows_of, flat, n = [], [], [], 0
        for pdf in batches:                       # the bounded sample, active buckets only
            for g, idx in zip(pdf["grade"], pdf["idx"], strict=True):
                at = [col[b] for b in idx if b in col]
                y.append(number[g])
                rows_of.append(np.full(len(at), n))
                flat.append(np.array(at, dtype=np.int64))
                n += 1
        if n:
            yield pd.DataFrame({"x": [_solve(np.array(y), np.concatenate(rows_of), np.concatenate(flat),
                                             std, cuts0, l2)]})

    x = np.array(rows.coalesce(1).mapInPandas(solve, "x array<double>").first()["x"])
    sc.drop("sample")
    cuts = x[f_n] + np.concatenate([[0.0], np.cumsum(np.exp(x[f_n + 1:]))])
    w = x[:f_n] / std
    return OrdinalModel({b: float(w[i]) for b, i in col.items()}, cuts.tolist(), grades)


def score(docs: DataFrame, model: OrdinalModel | None, min_tail: float = 0.5) -> DataFrame:
    """``doc_id, score, expected_grade, tail_prob, kept`` per row of ``docs``."""
    src = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    if model is None:
        null = F.lit(None).cast("double")
        return src.select("doc_id", null.alias("score"), null.alias("expected_grade"),
                          null.alias("tail_prob"), F.lit(True).alias("kept"))
    schema = f"doc_id {id_type}, score double, expected_grade double, tail_prob double, kept boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = model.scorer().__getitem__
        cuts = np.array(model.thresholds)
        steps = np.diff(np.array(model.grades, dtype=float))
        for pdf in batches:
            s = np.array([sum(map(weight, sorted(tokens(x)))) for x in pdf["text"]], dtype=float)
            tail = _sigmoid(s[:, None] - cuts[None, :])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s,
                                "expected_grade": model.grades[0] + tail @ steps,
                                "tail_prob": tail[:, -1], "kept": tail[:, -1] >= min_tail})

    return src.mapInPandas(run, schema)


def select(docs: DataFrame, model: OrdinalModel | None, min_tail: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns, in one pass."""
    if model is None:
        return docs

    def run(batches):
        weight, cut = model.scorer().__getitem__, model.thresholds[-1]
        for batch in batches:
            s = np.array([sum(map(weight, sorted(tokens(x)))) for x in batch["text"].to_pylist()], dtype=float)
            yield batch.filter(pa.array(_sigmoid(s - cut) >= min_tail))

    return docs.mapInArrow(run, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Three grades from the two flags: 0 poor, 1 well written but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame,
             rated_docs: DataFrame | None = None) -> DataFrame:
    """Fit on the rated rows of ``rated_docs`` (default ``docs``) and score ``docs``."""
    return score(docs, fit(docs if rated_docs is None else rated_docs, graded(labels)))

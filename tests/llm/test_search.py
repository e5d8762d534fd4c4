"""Ranked lexical search and nearest vectors against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import mask_search, vector_search
from tests.llm.cases import empty, frame, odd_documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _ranked(docs, items, k=10):
    held = [(i, Counter(_terms(t))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(_terms(t))
    out = {}
    for item, ts in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in ts}
        rows = []
        for doc, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            rows.append((-sum(w[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c), doc))
        out[item] = [(r + 1, d, -s) for r, (s, d) in enumerate(sorted(x for x in rows if x[0])[:k])]
    return {i: v for i, v in out.items() if v}


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("term", F.lit("own"))


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


def test_search_odd_cases(spark):
    docs = [*odd_documents(), *[(200 + i, prose(5, 40)) for i in range(30)], (300, "Ünïcode WÖRDS don't A1-b2")]
    items = [(1, prose(3, 20)), (2, "don't é ß A1"), (3, None), (4, ""), (5, "nowhere"), (6, "alpha0 Alpha0"),
             (6, "bravo3"), (None, "alpha0"), (7, prose(5, 40)), (8, " ".join(t for _, x in docs[:12] for t in [x]))]
    got = _found(mask_search.search(frame(spark, docs), _items(spark, items)))
    assert got == _ranked(docs, items)
    assert len(set(_terms(items[-1][1]))) > 64            # masks of more than one word
    assert [d for _, d, _ in got[7]] == [*range(200, 210)]  # ties by doc_id


def test_search_in_blocks_and_small_tasks(spark):
    docs = [(i, prose(i % 40, 20 + i % 7)) for i in range(400)]
    items = [(i, prose(i, 15)) for i in range(25)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = _found(mask_search.search(frame(spark, docs), _items(spark, items), k=7, block_bytes=4000))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == _ranked(docs, items, k=7)


def test_search_stops_early_and_empty_tables(spark):
    import pandas as pd
    rows = [(i, 50, [0, 1, 2] if i < 12 else [i % 3], [1 + (i < 12)] * (3 if i < 12 else 1)) for i in range(5000)]
    pdf = pd.DataFrame([(i, n, np.array(t, "<u4").tobytes(), np.array(f, "<u4").tobytes()) for i, n, t, f in rows],
                       columns=["doc_id", "n", "terms", "tfs"])
    batch, heap = mask_search.Batch(pdf, np.array([10, 10, 10]), 5000, 250_000), []
    assert batch.search(np.array([0, 1, 2]), heap, 10) < 100      # one mask holds the best; the rest is not scored
    assert sorted(-d for _, d in heap) == list(range(10))
    assert mask_search.search(empty(spark), _items(spark, [(1, "alpha")])).count() == 0
    assert mask_search.search(frame(spark, odd_documents()), _items(spark, [])).count() == 0


def _brute(rows, k=20, every=20):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in ok if i % every == 0}:
        x = min((list(v) for i, v in ok if i == q))
        near = sorted((-sum(a * b for a, b in zip(x, v.tolist())), i) for i, v in ok if i != q and len(v) == len(x))
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return {q: v for q, v in out.items() if v}


def _nearest(df, **kw):
    out = {}
    for r in vector_search.nearest(df, **kw).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("cell", [vector_search.CELL_BYTES, 2000])
def test_nearest_odd_cases(spark, monkeypatch, cell):
    monkeypatch.setattr(vector_search, "CELL_BYTES", cell)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=9).round(2).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]                       # a hot vector
    rows += [(500 + i, (rng.normal(size=9) * 10.0 ** rng.integers(-200, 100)).tolist()) for i in range(20)]
    rows += [(1000, None), (1001, []), (1020, [0.0] * 9), (1021, [1.0, None] + [0.0] * 7), (1040, [float("nan")] * 9),
             (1041, [float("inf")] * 9), (None, [1.0] * 9), (1060, [1.0, 2.0]), (1061, [3.0, 4.0]), (40, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("ids", F.lit("own"))
    assert _nearest(df) == _brute(rows)
    assert _nearest(df, k=3) == _brute(rows, k=3)
    assert vector_search.nearest(df.limit(0)).count() == 0


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 1200)) ** 3, rng.normal(size=(60, 1200))     # longer than one exact tile
    near, off = vector_search.bounds(vector_search.Quantised(a), vector_search.Quantised(b))
    assert (np.abs(near - a @ b.T) <= off).all()
    assert off.mean() < 0.05 * np.linalg.norm(a, axis=1).mean() * np.linalg.norm(b, axis=1).mean()

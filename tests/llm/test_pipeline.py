"""The corpus pipeline, stage by stage, on odd and on given tables."""

import re

import corpus_pipeline as P
from cohortlab.llm.common import Scratch
from tests.conftest import SF0001
from tests.llm.cases import empty, frame, odd_documents
from tests.llm.test_dedup import _components, _norm


def test_stages_are_those_dealt():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup",
                                        "benchmark decontamination", "packing"]


def test_every_stage_takes_odd_and_empty_tables(spark):
    for rows in (odd_documents(), []):
        docs = frame(spark, rows)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF0001)
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            assert out.count() <= docs.count()
        assert P.lexical_packing(spark, docs, SF0001).columns[0] == "doc_id"


def test_filter_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").drop("n_chars")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(_norm(t), i)
    assert ids(P.exact_dedup(spark, docs, SF0001)) == set(first.values())
    assert ids(P.minhash_near_dedup(spark, docs, SF0001)) == {i for i, c in _components(rows).items() if c[2]}
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    clean = {i for i, t in rows if not any(x in words(t) for x in items)}
    assert ids(P.benchmark_decontamination(spark, docs, SF0001)) == clean


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    sc = Scratch(spark, "by-hand")
    for i, (_, stage) in enumerate(P.STAGES):
        docs = sc.put(f"s{i}", stage(spark, docs, SF0001))
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    got = P.run(spark, SF0001).collect()
    assert sorted(map(key, got)) == sorted(map(key, docs.collect())) and got


def test_empty_corpus(spark):
    assert P.lexical_packing(spark, P.exact_dedup(spark, empty(spark), SF0001), SF0001).count() == 0

"""Token encoding, ORC files and packing: round trips and invariants."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortlab.llm import packing, token_orc
from cohortlab.llm.common import Scratch
from cohortlab.llm.encoding import BatchEncoder, tokenizer_path
from tests.conftest import SF0001
from tests.llm.cases import empty, frame, odd_documents


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_chunked_ids_equal_the_library(library):
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'", "12", ".", "!!", "é", "ß", "日本", "\x0b", "<|endoftext|>",
             "İ", "-", "x", "\r", "\x1c", "\x85", "ŉ", "ǅ", "\u3000", "word,", "Straße..", "²", "_"]
    enc = BatchEncoder(table_bytes=20_000)               # the table turns over many times
    for _ in range(150):
        texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(40)]
        for t, b in zip(texts, enc.encode(texts)):
            assert np.frombuffer(b, enc.dtype).tolist() == _ids(library, t), repr(t)


def test_whole_documents_equal_the_library(spark, library):
    enc = BatchEncoder()
    texts = [r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    for t, b in zip(texts, enc.encode(texts)):
        assert np.frombuffer(b, enc.dtype).tolist() == _ids(library, t)
    assert enc.encode([None, ""]) == [b"", b""]


def _check_round_trip(rows, got, library, end_id=2):
    named = defaultdict(list)
    for i, t in rows:
        if i is not None:
            named[i].append([*_ids(library, t), end_id])
    start = 0
    assert len(got) == sum(map(len, named.values()))
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == start
        assert any(r.n_tokens == len(x) and r.ids_crc32 == _crc(x) for x in named[r.doc_id])
        start += r.n_tokens


def test_orc_round_trip(spark, library):
    rows = odd_documents()
    _check_round_trip(rows, token_orc.round_trip(frame(spark, rows)).collect(), library)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _check_round_trip(rows, token_orc.round_trip(docs).collect(), library)


def test_orc_empty_table(spark):
    assert token_orc.round_trip(empty(spark)).count() == 0


def test_orc_files_ascend_and_lookups_prune(spark, library):
    from pyarrow import orc
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    path = Scratch(spark, "test-orc").path("t")
    token_orc.write(docs, path, files=4)
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)[::37]
    got = token_orc.lookup(spark, path, ids)
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: [*_ids(library, rows[i]), 2] for i in ids}
    # every file holds one ascending range, with row indexes and a Bloom filter
    import glob
    spans = []
    for f in glob.glob(path.replace("file:", "") + "/*.orc"):
        d = orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert d == sorted(d)
        spans.append((d[0], d[-1]))
    spans.sort()
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _check_packing(rows, got, library, size=packing.SIZE, end_id=0):
    named = defaultdict(list)
    for i, t in rows:
        if i is not None:
            named[i].append([*_ids(library, t), end_id])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert pieces.keys() == named.keys()
    for i, texts in named.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(texts[0])
                assert r.ids_crc32 == _crc(texts[0][at:at + r.length])
                at += r.length
            assert at == len(texts[0])
        else:
            assert sum(r.length for r in pieces[i]) == sum(map(len, texts))
    used = []
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        used.append(at)
    return used


def test_packing_places_every_id_once(spark, library):
    rows = odd_documents()
    used = _check_packing(rows, packing.pack(frame(spark, rows)).collect(), library)
    assert sum(u < packing.SIZE for u in used) <= 1          # one shard: one sequence is not full
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    used = _check_packing(rows, packing.pack(docs, shard_docs=60).collect(), library)
    assert sum(u < packing.SIZE for u in used) <= 4


def test_packing_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0


def test_packing_without_tails(spark, library):
    # a document of exactly one window leaves no tail
    n = next(k for k in range(1, 2000) if len(_ids(library, "a " * k)) == packing.SIZE - 1)
    got = packing.pack(frame(spark, [(1, "a " * n)])).collect()
    assert [(r.start, r.length, r.offset) for r in got] == [(0, packing.SIZE, 0)]


def test_shard_index_prefers_lexical_neighbours():
    rnd = np.random.default_rng(0)
    topics = [rnd.integers(100 * k + 100, 100 * k + 150, (20, 60)) for k in range(4)]
    tails = [t.astype(np.uint16) for k in topics for t in k]
    df = np.zeros(600)
    for t in tails:
        df[np.unique(t)] += 1
    shard = packing.Shard(tails, np.log(1 + (len(tails) - df + 0.5) / (df + 0.5)), 60.0)
    # brute force: BM25 over the seed's query terms
    for seed in (0, 25, 79):
        score = np.zeros(len(tails))
        for i, t in enumerate(tails):
            for q in shard.query[seed]:
                tf = (t == q).sum()
                idf = np.log(1 + (len(tails) - df[q] + 0.5) / (df[q] + 0.5))
                score[i] += idf * tf * (packing.K1 + 1) / (tf + packing.K1)
        used = np.zeros(len(tails), dtype=bool)
        used[seed] = True
        near = shard.neighbours(seed, used)
        score[seed] = 0
        assert set(near) == set(np.flatnonzero(score)) and np.allclose(score[near], np.sort(score[score > 0])[::-1])
        assert all(j // 20 == seed // 20 for j in near)
    windows = shard.pack(240)
    assert all(sum(n for _, _, n in w) == 240 for w in windows)
    pure = sum(len({i // 20 for i, _, _ in w}) == 1 for w in windows)
    assert pure >= 0.8 * len(windows)


def test_every_token_of_the_seed_counts():
    common = np.arange(100, 120)                               # 20 tokens of every seed are heavier than the last
    tails = [np.append(common, [7]), np.array([7, 8, 9]), np.append(common, [10])]
    tails = [t.astype(np.uint16) for t in tails]
    idf = np.full(130, 5.0)
    idf[7] = 1.0
    used = np.array([True, False, False])
    shard = packing.Shard(tails, idf, 15.0)
    assert shard.neighbours(0, used).tolist() == [2, 1]
    shard.shrink(np.array([False, False, True]))
    assert shard.neighbours(0, used).tolist() == [1]

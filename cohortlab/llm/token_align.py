"""Alignment of two tokenizers over a corpus, with corpus-wide counts of id pairs.

A text is encoded by a byte-level vocabulary (A, a space before the text) and by a
sentencepiece vocabulary (B, which adds that space). Byte offsets at which tokens
of both end cut the text into groups; every A-B token pair of a group is a link.

1.  One pass over the whole texts writes per document its counts, the digest of its
    groups and its distinct linked id pairs with their multiplicity.
2.  Counting: ``same_bytes`` maps each A id to the B id of the same bytes. Exact
    one-to-one groups link an id with its image, so their documents are counted in
    vectors of vocabulary length, one a task. Only the other pairs are counted by a
    shuffle, after a count inside each batch.
3.  The identity vector and each A id's best count have one entry an A id. Of the
    other pairs the most frequent are broadcast, at most ``HOT_PAIRS`` of them; a
    document's remaining pairs are joined with the counted pairs by a shuffle. So
    what is broadcast has a fixed bound and the sums are exact at every size.

Texts that are null or empty, or whose joined token bytes differ from the text with
its space, have no tokens: zeros and an empty digest. Strings of special tokens in a
text are plain text. Repeated rows of a doc_id are documents of their own; rows
without one are left out. Other columns are not read. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch
from cohortlab.llm.encoding import (VOCABULARY, ChunkTable, byte_letters, chunked, encoder, parts, runs,
                                     slices, tokenizer_path)

PIECES = "piece_bpe_32k.model"
#: Irregular pairs whose counts are broadcast (16 bytes each); the rest is joined.
HOT_PAIRS = 1 << 21
#: Groups with more links than this are expanded by distinct ids instead of tokens.
WIDE_GROUP = 1 << 12

_DOC = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups_sha256 string, pairs binary, times binary")
_SUMS = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
         "groups_sha256 string, n_best bigint, count_sum bigint, rest_pairs array<bigint>, rest_times array<bigint>")


def _labels(n: int, inner: str, last: str) -> np.ndarray:
    """Decimal ids followed by a mark: entry 2i inside a group, 2i+1 at its end."""
    return np.array([f"{i}{m}" for i in range(n) for m in (inner, last)], dtype="S")


class Aligner:
    """Both vocabularies, the identity map between them and the groups of a text."""

    def __init__(self, vocabulary: str = VOCABULARY, pieces: str = PIECES):
        import sentencepiece
        self.a = encoder(vocabulary, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces))
        back = {c: i for i, c in enumerate(byte_letters())}
        vocab = self.a.tok.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = (bytes(map(back.__getitem__, token)) if set(token) <= back.keys() else token.encode())
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.len_a, self.len_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # no piece holds a space behind another character: a text's chunks are encoded apart
        self.whole_words = not any(b" " in p.lstrip(b" ") for p in self.bytes_b)
        first: dict[bytes, int] = {}
        for i, p in enumerate(self.bytes_b):
            first.setdefault(p, i)
        #: A id -> B id of the same bytes, -1 where there is none.
        self.same_bytes = np.array([first.get(p, -1) for p in self.bytes_a], dtype=np.int64)
        # the order of the marks: a1,a2|b1;a3|b2,b3
        self.text_a, self.text_b = _labels(len(self.bytes_a), ",", "|"), _labels(len(self.bytes_b), ",", ";")
        width = max(self.text_a.dtype.itemsize, self.text_b.dtype.itemsize)
        self.label = np.dtype(f"S{width}")
        #: chunk -> its sizes, its groups in writing, its links
        self.table = ChunkTable(self.learn)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B for a text; none where their bytes differ from it."""
        want = " " + text
        a = self.a.ids(want).astype(np.int64)
        b = [i for p in (parts(want) if self.whole_words else [want]) for i in self.b.encode(p[1:], num_threads=1)]
        want = want.encode()
        if (b"".join(map(self.bytes_b.__getitem__, b)) != want
                or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want):
            return None
        return a, np.array(b, dtype=np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ends of the groups; group and writing place of the tokens; links and
        their groups. The ids are those of one text or of chunks behind each other."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        ga, gb = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        na, nb = np.bincount(ga, minlength=len(ends)), np.bincount(gb, minlength=len(ends))
        from_a, from_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        # in writing, the A tokens of a group stand before its B tokens
        out = np.empty(len(a) + len(b), dtype=self.label)
        out[np.arange(len(a)) + from_b[ga]] = self.text_a[2 * a + (end_a == ends[ga])]
        out[np.arange(len(b)) + (from_a + na)[gb]] = self.text_b[2 * b + (end_b == ends[gb])]
        # one-to-one groups (the identity map in most cases), then the irregular ones
        n = na * nb
        one = np.flatnonzero(n == 1)
        pair, group = [a[from_a[one]] << 32 | b[from_b[one]]], [one]
        ia = np.flatnonzero(((n > 1) & (n <= WIDE_GROUP))[ga])
        per = nb[ga[ia]]
        left = np.repeat(ia, per)
        step = np.arange(len(left)) - np.repeat(np.cumsum(per) - per, per)
        pair.append(a[left] << 32 | b[from_b[ga[left]] + step])
        group.append(ga[left])
        times = [np.ones(len(one) + len(left), dtype=np.int64)]
        for g in np.flatnonzero(n > WIDE_GROUP):              # by distinct ids
            ua, ca = np.unique(a[from_a[g]:from_a[g] + na[g]], return_counts=True)
            ub, cb = np.unique(b[from_b[g]:from_b[g] + nb[g]], return_counts=True)
            pair.append((ua[:, None] << 32 | ub[None, :]).ravel())
            times.append((ca[:, None] * cb[None, :]).ravel())
            group.append(np.full(len(pair[-1]), g))
        return (ends, na, nb, n, out,
                np.stack([np.concatenate(pair), np.concatenate(times)], axis=1), np.concatenate(group))

    def learn(self, here: list[str]) -> Iterator[tuple[str, object, int]]:
        """Align new chunks, each with a space before it, as one text."""
        got = self.encode(" ".join(here))
        if got is None:                          # find the chunks that their tokens do not give back
            if len(here) == 1:
                yield here[0], False, 0
            else:
                yield from self.learn(here[:len(here) // 2])
                yield from self.learn(here[len(here) // 2:])
            return
        ends, na, nb, n, out, links, group = self.align(*got)
        chunk = np.searchsorted(np.cumsum([len(c.encode()) + 1 for c in here]), ends)     # of each group
        sizes = np.stack([np.bincount(chunk, w, minlength=len(here)) for w in (na, nb, np.ones(len(n)), n)], axis=1)
        sizes = sizes.astype("<i8")
        cuts = [0, *np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()]
        owner = chunk[group]
        links = links[np.argsort(owner, kind="stable")].astype("<i8")
        ends = [0, *np.cumsum(np.bincount(owner, minlength=len(here))).tolist()]
        for i, c in enumerate(here):
            value = (sizes[i].tobytes(), out[cuts[i]:cuts[i + 1]].tobytes().translate(None, b"\0")[:-1],
                     links[ends[i]:ends[i + 1]].tobytes())
            yield c, value, sum(map(len, value)) + 150

    def _whole(self, text: str) -> Document | None:
        got = self.encode(text)
        if got is None:
            return None
        ends, na, nb, n, out, links, _ = self.align(*got)
        doc = Document()
        doc.add(np.array([[na.sum(), nb.sum(), len(n), n.sum()]]), out.tobytes().translate(None, b"\0")[:-1], links)
        return doc

    def documents(self, texts: list[str | None]) -> list[Document | None]:
        """What each text links; none where it has no tokens."""
        out: list[Document | None] = [Document() if t else None for t in texts]
        queue, owner, odd = [], [], set()
        for i, t in enumerate(texts):
            if t and self.whole_words and self.a.chunked:
                for p in parts(" " + t):
                    queue.append(p)
                    owner.append(i)
            elif t:
                odd.add(i)
        for run in runs(queue):
            words = [chunked(queue[i]) for i in run]
            for w in words:
                if w:
                    w.pop(0)                     # before the first space: empty
            for i, got in zip(run, self.table.values_of(words), strict=True):
                if got is None or False in got:
                    odd.add(owner[i])
                elif owner[i] not in odd:
                    sizes, written, links = zip(*got)
                    out[owner[i]].add(np.frombuffer(b"".join(sizes), dtype="<i8").reshape(-1, 4), b";".join(written),
                                      np.frombuffer(b"".join(links), dtype="<i8").reshape(-1, 2))
        for i in odd:
            out[i] = self._whole(texts[i])
        return out


class Document:
    """Sizes, digest and links of a text, added up part by part."""

    def __init__(self):
        self.sizes, self.digest, self.links = np.zeros(4, dtype=np.int64), None, []

    def add(self, sizes: np.ndarray, written: bytes, links: np.ndarray) -> None:
        self.sizes += sizes.sum(axis=0)
        if self.digest is None:
            self.digest = hashlib.sha256(written)
        else:
            self.digest.update(b";" + written)
        self.links.append(links)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs (A id << 32 | B id), ascending, and their multiplicity."""
        pair, times = np.concatenate(self.links).T
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        return pair[first], np.add.reduceat(times[order], first)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(vocabulary: str = VOCABULARY, pieces: str = PIECES) -> Aligner:
    """The worker's aligner of two vocabularies."""
    key = (vocabulary, pieces)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _align(batches: Iterator[pd.DataFrame], vocabulary: str, pieces: str) -> Iterator[pd.DataFrame]:
    al, row = aligner(vocabulary, pieces), TaskContext.get().partitionId() << 40
    for batch in batches:
        for pdf in slices(batch, rows=512, chars=2_000_000):
            rows = []
            for doc_id, doc in zip(pdf["doc_id"], al.documents(pdf["text"].tolist()), strict=True):
                row += 1
                if doc is None:
                    rows.append((row, doc_id, 0, 0, 0, 0, "", b"", b""))
                    continue
                key, n = doc.pairs()
                rows.append((row, doc_id, *doc.sizes.tolist(), doc.digest.hexdigest(), _packed(key),
                             n.astype("<u8" if n.max() >= 1 << 32 else "<u4").tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DOC.split(", ")])


def _packed(key: np.ndarray) -> bytes:
    """Ascending pairs as two planes of 32-bit numbers: steps of the A id, B ids."""
    return np.concatenate([np.diff(key >> 32, prepend=0), key & 0xFFFFFFFF]).astype("<u4").tobytes()


def _unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, b = np.frombuffer(pairs, dtype="<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(step) << 32 | b, np.frombuffer(times, dtype=f"<u{len(times) // max(len(b), 1) or 4}").astype(np.int64)


def _counts(batches: Iterator[pd.DataFrame], same: np.ndarray, held: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Documents of each pair: identity pairs in one vector, the others counted in
    batches of about ``held`` before they leave the task."""
    vector, rest, n = np.zeros(len(same), dtype=np.int64), [], 0
    for pdf in batches:
        for pairs, times in zip(pdf["pairs"], pdf["times"], strict=True):
            key, _ = _unpacked(pairs, times)
            a = key >> 32
            image = same[a] == key & 0xFFFFFFFF
            vector[a[image]] += 1                       # a document holds a pair once
            rest.append(key[~image])
            n += len(rest[-1])
            if n >= held:
                yield _frame(rest)
                rest, n = [], 0
    if rest:
        yield _frame(rest)
    at = np.flatnonzero(vector)
    yield pd.DataFrame({"pair": at << 32 | same[at], "n": vector[at]})


def _frame(rest: list[np.ndarray]) -> pd.DataFrame:
    key, n = np.unique(np.concatenate(rest), return_counts=True)
    return pd.DataFrame({"pair": key, "n": n})


def _sums(batches: Iterator[pd.DataFrame], hot: np.ndarray, hot_n: np.ndarray, best: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sums over the pairs that are at hand, and the pairs that are not."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            key, times = _unpacked(r.pairs, r.times)
            at = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
            known = hot[at] == key if len(hot) else np.zeros(len(key), dtype=bool)
            n, t = hot_n[at[known]], times[known]
            top = n == best[key[known] >> 32]
            rows.append((r.row, r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256,
                         int(t[top].sum()), int((t * n).sum()), key[~known], times[~known]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SUMS.split(", ")])


def align(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES,
          hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document."""
    spark = docs.sparkSession
    sc = Scratch(spark, "token-align")
    src = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    linked = sc.put("linked", src.mapInPandas(lambda it: _align(it, vocabulary, pieces), _DOC), compression="zstd")
    same = aligner(vocabulary, pieces).same_bytes
    shared = spark.sparkContext.broadcast(same)
    counted = sc.put("counted", linked.select("pairs", "times")
                     .mapInPandas(lambda it: _counts(it, shared.value), "pair bigint, n bigint")
                     .groupBy("pair").agg(F.sum("n").alias("n")))
    a_id = F.shiftright("pair", 32)
    top = counted.groupBy(a_id.cast("int").alias("a")).agg(F.max("n").alias("n")).toPandas()   # one row an A id
    best = np.zeros(len(same), dtype=np.int64)
    best[top["a"].to_numpy()] = top["n"].to_numpy()
    # the most frequent pairs: those above the least power of two that leaves few enough
    power = F.floor(F.log2("n")).cast("int")
    sizes = sorted(((r["p"], r["count"]) for r in counted.groupBy(power.alias("p")).count().collect()), reverse=True)
    held, least = 0, None
    for p, n in sizes:                                        # at most 63 rows
        if held + n > hot_pairs:
            break
        held, least = held + n, p
    hot = counted.filter(power >= (64 if least is None else least)).toPandas().sort_values("pair")   # at most hot_pairs
    plan = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), best))
    sums = sc.put("sums", linked.mapInPandas(lambda it: _sums(it, *plan.value), _SUMS), compression="zstd")
    sc.drop("linked")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if sum(n for _, n in sizes) == held:
        return sums.select(*out, "n_best", "count_sum", "groups_sha256")
    tops = spark.createDataFrame(top.astype({"a": "int64", "n": "int64"}).rename(columns={"n": "most"}))
    rest = (sums.select("row", F.explode(F.arrays_zip("rest_pairs", "rest_times")).alias("z"))
            .select("row", F.col("z.rest_pairs").alias("pair"), F.col("z.rest_times").alias("t"))
            .join(counted.filter(power < (64 if least is None else least)), "pair")
            .join(F.broadcast(tops), F.shiftright("pair", 32) == F.col("a"))
            .groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("t")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("t") * F.col("n")).alias("more_sum")))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (sums.drop("rest_pairs", "rest_times").join(rest, "row", "left")
            .select(*out, (F.col("n_best") + more("more_best")).alias("n_best"),
                    (F.col("count_sum") + more("more_sum")).alias("count_sum"), "groups_sha256"))

"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other
numbers or names has the template of the original. Windows of template tokens
are hashed and joined with the benchmark's windows. An alignment of a document
with an item is a chain of matched windows that ascend in both; from one to the
next the shift between the two may change by ``GAP`` tokens. Along it the values
in the slots must be consistent: every value of the item stands for one value in
the document and the other way round. Where two slots disagree, the pair of values
seen at more places of the item holds (at a tie neither), and the windows over a
slot that does not hold are not counted.

*   number: a token that starts with a digit; unit: a unit word right after a
    number; name: a word with a capital first letter and small letters after it.
    All other tokens are literal, case-folded; punctuation is left out. A run of
    numbers or of names is one slot, however many tokens it has (Paris, New York;
    1000, 1 000).
*   Every text has two templates, matched side by side: one with name slots, and
    one whose words are all literal, so that the case of a copy plays no part.
    Each counts its own windows; a hit of either is a hit.
*   Items with fewer tokens than a window count as one window of their length.
    Windows with fewer than ``MIN_LITERALS`` literal tokens carry no template
    and are left out on both sides.
*   A document is contaminated by an item when one consistent alignment matches
    at least ``coverage`` of the item's windows.

The benchmark's window hashes go to every task while their counted size fits
the broadcast bound; beyond it all document windows are shuffled instead. Texts
never leave their task, only matching windows do. Null or empty texts and items
match nothing; an empty benchmark leaves every document. Repeated rows of one
doc_id are one document; rows without a doc_id are left out. Other columns are
not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import BROADCAST_BYTES, Scratch
from cohortlab.llm.encoding import slices
from cohortlab.llm.shingles import mix64

WINDOW = 8
MIN_LITERALS = 3
COVERAGE = 0.5
GAP = 8
_CACHE = 100_000

# Unit words.
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres "
    "g kg mg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces "
    "s ms sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months "
    "year years l ml liter liters litre litres gallon gallons cup cups "
    "percent dollar dollars cent cents euro euros usd eur mph kmh kph degree degrees "
    "watt watts volt volts joule joules kw kwh hz khz mhz ghz kb mb gb tb".split())

_TOKEN = re.compile(r"\d[\w.,:/]*\w|\w+")
_NUMBER, _UNIT, _NAME = (xxhash.xxh64_intdigest(f"\x00slot {x}") for x in ("number", "unit", "name"))
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """token -> number of the token; ``code`` and ``kind`` by number: kind 0 literal,
    1 number, 2 unit word, 3 name."""

    def __init__(self) -> None:
        self.code, self.kind = np.zeros(1024, np.uint64), np.zeros(1024, np.int8)

    def __missing__(self, t: str) -> int:
        k, low = len(self), t.casefold()
        if k == len(self.code):
            self.code, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.code, self.kind))
        if t[0].isdigit():
            self.code[k], self.kind[k] = _NUMBER, 1
        else:
            self.code[k] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
            self.kind[k] = 2 if low in UNITS else 3 if len(t) > 1 and t[0].isupper() and t[1:].islower() else 0
        self[t] = k
        return k


class Template:
    """One template of a run of texts laid end to end: per token of the template the text
    it is of (``owner``), its code, whether it is a slot and its first token of the text."""

    def __init__(self, tokens: list[str], code: np.ndarray, kind: np.ndarray, owner: np.ndarray, names: bool):
        self.tokens, self.salt = tokens, np.uint64(0 if names else 1 << 32)
        same = np.zeros(len(code), bool)                 # as the token before, of one text
        same[1:] = owner[1:] == owner[:-1]
        unit = kind == 2
        unit[1:] &= kind[:-1] == 1
        unit &= same
        name = (kind == 3) & names
        slot = (kind == 1) | unit | name
        more = np.zeros(len(code), bool)                 # goes on with the slot of the token before
        more[1:] = slot[1:] & ~unit[1:] & same[1:] & slot[:-1] & (kind[1:] == kind[:-1])
        self.at = np.append(np.flatnonzero(~more), len(code))
        at = self.at[:-1]
        self.slot, self.owner = slot[at], owner[at]
        self.code = np.where(unit, np.uint64(_UNIT), np.where(name, np.uint64(_NAME), code))[at]
        self.first = np.searchsorted(self.owner, np.arange(owner[-1] + 1 if len(owner) else 0))

    def value(self, p: int) -> str:
        return "".join(self.tokens[self.at[p]:self.at[p + 1]]).casefold()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``size``, within one text, with enough literals."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.full(n, np.uint64(size) + self.salt, dtype=np.uint64)
        for i in range(size):
            h = h * _MUL + self.code[i:i + n]
        filled = np.concatenate([[0], np.cumsum(self.slot)])
        ok = (size - (filled[size:] - filled[:n]) >= MIN_LITERALS) & (self.owner[:n] == self.owner[size - 1:])
        return np.flatnonzero(ok), mix64(h[ok])

    def rows(self, ids: list[int], at: np.ndarray, h: np.ndarray, size: int) -> list[tuple]:
        out, plain = [], self.salt > 0
        for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
            k = self.owner[p]
            start = int(self.first[k])
            out.append((ids[k], plain, p - start, size, x, [
                (int(p + j) - start, self.value(p + j)) for j in np.flatnonzero(self.slot[p:p + size])]))
        return out


def templates(texts: list[str | None], codes: _Codes) -> list[Template]:
    """The two templates of texts: with name slots, and with all words literal."""
    if len(codes) >= _CACHE:
        codes.clear()
    per = [_TOKEN.findall(x) if x else [] for x in texts]
    tokens = list(chain.from_iterable(per))
    k = np.fromiter(map(codes.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    owner = np.repeat(np.arange(len(per)), [len(x) for x in per])
    return [Template(tokens, codes.code[k], codes.kind[k], owner, names) for names in (True, False)]


_WINDOW = "id bigint, plain boolean, pos int, size int, h bigint, slots array<struct<at:int,v:string>>"
_COLUMNS = ["id", "plain", "pos", "size", "h", "slots"]


def _benchmark(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    codes = _Codes()
    for pdf in batches:
        rows = []
        for i, x in zip(pdf["id"], pdf["text"], strict=True):
            for t in templates([x], codes):
                size = min(window, len(t.code))
                if size:
                    rows += t.rows([i], *t.windows(size), size)
        yield pd.DataFrame(rows, columns=_COLUMNS)


def _documents(batches: Iterator[pd.DataFrame], sizes: list[int],
               known: np.ndarray | None) -> Iterator[pd.DataFrame]:
    codes = _Codes()
    for batch in batches:
        for pdf in slices(batch, chars=500_000):
            ids, rows = pdf["id"].tolist(), []
            for t in templates(pdf["text"].tolist(), codes):
                for size in sizes:
                    at, h = t.windows(size)
                    if known is not None and len(h):
                        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                        at, h = at[hit], h[hit]
                    rows += t.rows(ids, at, h, size)
            yield pd.DataFrame(rows, columns=_COLUMNS)


def chains(pairs: list[tuple[int, int]], need: float) -> list[list[int]]:
    """Numbers of the (pos, ipos) of every longest chain that no other goes on with, and of every
    line of one shift, of at least ``need`` windows. ``pairs`` are sorted and distinct."""
    lines: dict[int, list[int]] = {}                     # shift -> numbers, ascending in pos
    count, back, last = [1] * len(pairs), [-1] * len(pairs), [True] * len(pairs)
    ends: dict[int, tuple[list[int], list[int]]] = {}    # shift -> pos, number of the longest chain up to it
    for k, (pos, ipos) in enumerate(pairs):
        shift = pos - ipos
        for s in sorted(range(shift - GAP, shift + GAP + 1), key=lambda s: abs(s - shift)):
            if s in ends:
                at, best = ends[s]
                j = bisect_left(at, min(pos, ipos + s)) - 1
                if j >= 0 and count[best[j]] + 1 > count[k]:
                    count[k], back[k] = count[best[j]] + 1, best[j]
        if back[k] >= 0:
            last[back[k]] = False
        lines.setdefault(shift, []).append(k)
        at, best = ends.setdefault(shift, ([], []))
        at.append(pos)
        best.append(k if not best or count[k] >= count[best[-1]] else best[-1])
    out = [x for x in lines.values() if len(x) >= need]
    for k in range(len(pairs)):
        if last[k] and count[k] >= need:
            one = []
            while k >= 0:
                one.append(k)
                k = back[k]
            out.append(one)
    return out


def holding(windows: list[list[tuple[int, str, str]]]) -> int:
    """How many windows of slots (place in the item, its value, the document's value) are consistent."""
    seen = Counter((i, d) for _, i, d in {x for w in windows for x in w})
    of_i, of_d = defaultdict(list), defaultdict(list)
    for (i, d), n in seen.items():
        of_i[i].append(n)
        of_d[d].append(n)
    top = lambda n, all_: n == max(all_) and all_.count(n) == 1
    holds = {x for x, n in seen.items() if top(n, of_i[x[0]]) and top(n, of_d[x[1]])}
    return sum(all((i, d) in holds for _, i, d in w) for w in windows)


def _aligned(batches: Iterator[pd.DataFrame], coverage: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, item, of, found in zip(pdf["doc_id"], pdf["item_id"], pdf["of"], pdf["w"], strict=True):
            slots = {(w["pos"], w["ipos"]): [(x["at"], x["i"], x["d"]) for x in w["m"]] for w in found}
            pairs, need = sorted(slots), coverage * of
            matched = max((holding([slots[pairs[k]] for k in c]) for c in chains(pairs, need)), default=0)
            if matched and matched >= need:
                rows.append((doc, item, matched, of))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched", "of"])


def _texts(df: DataFrame, id_col: str) -> DataFrame:
    return df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))


def rare_windows(bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``h, item_id, plain``: of each item's ``of`` windows the ``of - need + 1`` that fewest items hold.

    A hit holds at least ``need`` (``coverage`` of ``of``, rounded up) of an item's windows, so it holds one
    of these, whichever they are: they name every hit. A prompt line that many items
    share names no pair of a document and an item whose own words the document lacks.
    """
    held = bench.groupBy("h").agg(F.countDistinct("id").alias("held"))
    of = bench.groupBy("id", "plain").agg(F.countDistinct("pos").alias("of"))
    by_rarity = Window.partitionBy("id", "plain").orderBy("held", "h", "pos")
    need = F.greatest(F.ceil(F.lit(coverage) * F.col("of")), F.lit(1))
    return (bench.select("h", "id", "plain", "pos").join(held, "h")
            .withColumn("at", F.row_number().over(by_rarity)).join(of, ["id", "plain"])
            .filter(F.col("at") <= F.col("of") - need + 1)
            .select("h", F.col("id").alias("item_id"), "plain").distinct())


def candidates(found: DataFrame, rare: DataFrame) -> DataFrame:
    """``doc_id, item_id, plain``: pairs named by a rare window of the item."""
    return (found.select(F.col("id").alias("doc_id"), "h").distinct().join(rare, "h")
            .select("doc_id", "item_id", "plain").distinct())


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, windows, covered``: the best consistent alignment of every hit."""
    sc = Scratch(docs.sparkSession, "decontaminate")
    bench = sc.put("bench", _texts(benchmark, "item_id").dropDuplicates(["id"])
                   .mapInPandas(lambda it: _benchmark(it, window), _WINDOW))
    hashes = bench.select("h").distinct()
    n_windows, n_hashes = bench.agg(F.count("h"), F.countDistinct("h")).first()
    sizes = [r[0] for r in bench.select("size").distinct().orderBy("size").collect()]  # at most `window`
    known = None
    if n_hashes * 8 <= BROADCAST_BYTES:
        known = np.sort(hashes.toArrow()["h"].to_numpy().view(np.uint64))
    if not n_hashes:
        found = docs.sparkSession.createDataFrame([], _WINDOW)
    else:
        found = _texts(docs, "doc_id").mapInPandas(lambda it: _documents(it, sizes, known), _WINDOW)
        if known is None:
            found = found.join(hashes, "h", "left_semi").select(*_COLUMNS)
    found = sc.put("found", found)
    small = n_windows * 400 <= BROADCAST_BYTES
    hint = F.broadcast if small else lambda df: df
    # every window of a pair that a rare one has named; the hash tells the two templates apart
    b = bench.select("h", F.col("id").alias("item_id"), "plain", F.col("pos").alias("ipos"),
                     F.col("slots").alias("islots"))
    named = candidates(found, hint(sc.put("rare", rare_windows(bench, coverage))))
    pairs = (named.join(hint(b), ["item_id", "plain"])
             .join(found.select(F.col("id").alias("doc_id"), "h", "pos", "slots"), ["doc_id", "h"]))
    total = bench.groupBy(F.col("id").alias("item_id"), "plain").agg(F.countDistinct("pos").alias("of"))
    # slots of a window pair stand side by side: the templates are equal
    both = F.transform(F.arrays_zip("islots", "slots"), lambda x: F.struct(
        x["islots"]["at"].alias("at"), x["islots"]["v"].alias("i"), x["slots"]["v"].alias("d")))
    lines = (pairs.groupBy("doc_id", "item_id", "plain").agg(
        F.countDistinct("ipos").alias("matched"),
        F.collect_set(F.struct("pos", "ipos", both.alias("m"))).alias("w"))
        .join(total, ["item_id", "plain"]).filter(F.col("matched") >= F.lit(coverage) * F.col("of"))
        .select("doc_id", "item_id", "of", "w"))
    best = lines.mapInPandas(lambda it: _aligned(it, coverage), "doc_id bigint, item_id bigint, matched bigint, of bigint")
    return best.groupBy("doc_id", "item_id").agg(F.max("matched").alias("windows"),
                                                 F.max(F.col("matched") / F.col("of")).alias("covered"))


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_items, covered, kept`` for every document."""
    hits = contaminated(docs, benchmark).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.max("covered").alias("covered"))
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return ids.join(hits, "doc_id", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("covered", F.lit(0.0)).alias("covered"), F.col("n_items").isNull().alias("kept"))

"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges.

1.  One pass over the texts gives each document the size and fingerprint of its
    5-word shingle set and the band keys of its one-permutation sketch (optimal
    densification fills empty bins). Equal sets collapse to one representative.
2.  Documents that share a band key form a bucket. A bucket of m members emits
    m - 1 candidate edges: every member against the bucket's centre, the member
    with the most company over all its buckets.
3.  Candidates are confirmed on the full sets, components follow by label
    propagation over the confirmed edges.
4.  A star can miss a link between two members that are both unlike the centre.
    Members of buckets that still span several components therefore go through
    an exact prefix join: two sets with 100 * |A & B| >= 85 * |A | B| must share
    one of their few rarest shingles. Pairs across components are confirmed and
    joined in. No bucket is capped and no pair list of a group is written.

Nulls and empty texts have an empty set: ``n_shingles`` 0, linked with nothing.
Rows without a doc_id have no name to report and are left out. Repeated rows of
one doc_id share its set and component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch, join_small
from cohortlab.llm.shingles import OnePermutation, band_keys, shingle_set

#: 24 bands of 4: two sets at similarity 0.85 share no band with probability 2e-8.
BANDS, ROWS = 24, 4
THRESHOLD_PERCENT = 85


def _signatures(batches: Iterator[pd.DataFrame], bands: int, rows: int) -> Iterator[pd.DataFrame]:
    import xxhash
    oph = OnePermutation(bands * rows)
    for pdf in batches:
        n, fp, keys = [], [], []
        for text in pdf["text"]:
            s = shingle_set(text)
            n.append(len(s))
            fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(band_keys(oph.sketch(s), rows) if len(s) else None)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": np.array(n, dtype=np.int64),
                            "fp": fp, "bands": keys})


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, fp binary, bands array<bigint>`` per document."""
    src = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(lambda it: _signatures(it, bands, rows),
                           "doc_id bigint, n_shingles bigint, fp binary, bands array<bigint>")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"rep": pdf["doc_id"],
                            "shingles": [shingle_set(t).tobytes() for t in pdf["text"]]})


def _confirm(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            i = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(100 * i >= percent * (len(a) + len(b) - i))
        yield pdf.loc[ok, ["a", "b"]]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    n = F.octet_length("shingles")
    sa = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"), n.alias("na"))
    sb = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"), n.alias("nb"))
    # sizes further apart than the threshold can't reach it, whatever they share
    near = (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    sizes = (pairs.join(sa.select("a", "na"), "a").join(sb.select("b", "nb"), "b")
             .filter(near).select("a", "b"))
    return (sizes.join(sa.select("a", "sa"), "a").join(sb.select("b", "sb"), "b")
            .mapInPandas(lambda it: _confirm(it, percent), "a bigint, b bigint"))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``node, comp``: the smallest node reachable over undirected ``edges`` (a, b).

    Each round points every node at the smallest node among its neighbours and
    itself (partial minimum per task, so a hub costs no single task), and links
    those minima onward; the edge set shrinks to stars in a logarithmic number
    of rounds. Rounds are written to the shared folder.
    """
    cur = scratch.put(f"{label}-0", edges.select(F.least("a", "b").alias("v"),
                                                 F.greatest("a", "b").alias("u"))
                      .filter("u <> v").distinct())
    k = 0
    while True:
        # u > v throughout: v is a smaller node linked to u
        both = cur.union(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("x")).alias("m"))
        # large star: each larger neighbour of x is linked to x's minimum ...
        large = (cur.join(low.withColumnRenamed("x", "v"), "v")
                 .select(F.col("m").alias("v"), "u"))
        # ... small star: the smaller neighbours of u meet at their minimum
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_min, "u").filter("v <> m")
                 .select(F.col("m").alias("v"), F.col("v").alias("u")))
        nxt = scratch.put(f"{label}-{k + 1}", small.union(
            small_min.select(F.col("m").alias("v"), "u")).filter("u <> v").distinct())
        changed = nxt.exceptAll(cur).limit(1).count() or cur.exceptAll(nxt).limit(1).count()
        scratch.drop(f"{label}-{k}")
        cur, k = nxt, k + 1
        if not changed:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _prefix_pairs(residual: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles.

    ``residual``: ``rep, comp, shingles``. With n shingles in one common order
    (rarest first), sets that reach the threshold share one of the first
    n - ceil(percent% of n) + 1.
    """
    items = residual.select(
        "rep", "comp", (F.octet_length("shingles") / 8).cast("bigint").alias("n"),
        F.explode(F.transform(F.sequence(F.lit(0), (F.octet_length("shingles") / 8 - 1).cast("int")),
                              lambda i: F.substring("shingles", i * 8 + 1, F.lit(8)))).alias("s"))
    df = items.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # a shingle of one document joins with nothing, but takes its place in the order
    rare = items.groupBy("rep").agg(F.count(F.lit(1)).alias("n_all"))
    known = items.join(df, "s")
    per = known.groupBy("rep", "comp", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o"))
    per = per.join(rare, "rep")
    need = F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("int")
    # shingles of one document only stand first in its order: positions 0 .. own - 1
    own = F.col("n_all").cast("int") - F.size("o")
    keep = (F.col("n").cast("int") - need + 1) - own
    heads = (per.withColumns({"keep": keep, "own": own}).filter("keep > 0")
             .select("rep", "comp", "n", "own", F.posexplode(F.slice("o", F.lit(1), F.col("keep"))))
             .select("rep", "comp", "n", (F.col("own") + F.col("pos")).alias("p"), F.col("col.s").alias("s")))
    x = heads.select("s", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("p").alias("pa"))
    y = heads.select("s", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    # the first shingle that two sets share, at places pa and pb, bounds what they share
    # by what is left from there; the row of that shingle stays for every true pair
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    reach = (F.lit(100 + percent) * left >= F.lit(percent) * (F.col("na") + F.col("nb")))
    return (x.join(y, (x["s"] == y["s"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & reach)
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS,
                    percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    spark = docs.sparkSession
    sc = Scratch(spark, "near-dup")
    sig = sc.put("sig", signatures(docs, bands, rows))
    filled = sig.filter("n_shingles > 0")
    # one representative per distinct set; the partial minimum runs before the shuffle
    classes = sc.put("classes", filled.groupBy("fp").agg(
        F.min(F.struct("doc_id", "bands")).alias("m")).select(
        "fp", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")))
    keys = classes.select(F.explode("bands").alias("key"), "rep")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    member = sc.put("member", keys.join(shared, "key"))
    company = member.groupBy("rep").agg(F.sum("members").alias("company"))
    centre = member.join(company, "rep").groupBy("key").agg(
        F.max(F.struct("company", (-F.col("rep")).alias("neg"))).alias("c")).select(
        "key", (-F.col("c.neg")).alias("a"))
    star = sc.put("star", member.join(centre, "key").filter("a <> rep")
                  .select("a", F.col("rep").alias("b")).distinct())
    cand = sc.put("cand", company.select(F.col("rep").alias("doc_id")))
    n_cand = cand.count()
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
    sets = sc.put("sets", join_small(src, cand, "doc_id", "left_semi", n_cand, 16)
                  .mapInPandas(_sets, "rep bigint, shingles binary").dropDuplicates(["rep"]))
    links = sc.put("links", confirmed(star, sets, percent))
    comp = components(spark, links, sc, "cc1")

    # buckets that still span several components: their members meet in the prefix join
    labelled = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .filter("lo <> hi").select("key")
    residual = labelled.join(mixed, "key", "left_semi").select("rep", "comp").distinct()
    rest = _prefix_pairs(residual.join(sets, "rep"), percent).join(
        star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
        ["a", "b"], "left_anti")
    more = sc.put("more", confirmed(rest, sets, percent))
    if more.limit(1).count():
        comp = components(spark, links.union(more), sc, "cc2")

    named = classes.select("fp", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("fp", F.coalesce("comp", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "fp").join(named, "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sc.put("out", out.withColumn("kept", F.col("doc_id") == F.col("component_id")))
    sc.drop("sig", "classes", "member", "star", "cand", "sets", "links", "more",
            *[n for n in list(sc.paths) if n.startswith("cc")])
    return out

"""URL filter: host and path rules first, link-graph trust for the rest.

A rule names a host (with all its subdomains) and a path prefix; the longest
fitting rule decides. Pages without a rule get their host's verdict: trust is
personalised PageRank from hosts with allowed pages along host links, distrust
is the same from hosts with blocked pages against the links (whoever links to a
blocked host becomes suspect). A host is blocked when its distrust exceeds
``ratio`` times its trust, so a host that neither reaches is allowed. Rounds go
on until no rank changes by more than ``TOLERANCE`` of itself and no further host
is reached; ranks are compared as they are, by a share of themselves (``EQUAL``),
so verdicts do not depend on the number of seeds.

Links are ``href`` targets with a host; links inside one host carry nothing.
They are counted per host pair before any shuffle of the pairs, and ranks are
written to the shared folder every few rounds.

A null url or one without ``://`` has an empty host and path, no rule and the
verdict allow. Null html has no links. Repeated rows are judged alike and count
again as seeds and links. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import BROADCAST_BYTES, Scratch

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS, RATIO = 0.85, 10, 2.0
#: Ranks are settled below this relative change, looked at every so many rounds.
TOLERANCE, LOOK = 1e-6, 6
#: Ranks this near to each other, as a share, are equal.
EQUAL = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, null without one."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    to = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)))
    return (pages.select(host_of(F.col("url")).alias("src"), to.alias("to"))
            .select("src", F.translate("to", UPPER, LOWER).alias("dst")).filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(seeds: DataFrame, links: DataFrame, scratch: Scratch, damping: float = DAMPING,
              rounds: int | None = ROUNDS) -> DataFrame:
    """``host, kind, rank`` after ``rounds`` of personalised PageRank, or with None
    when all ranks have settled.

    ``seeds``: ``host, kind, seed`` (shares that sum to 1 per kind); trust walks
    along the links, distrust against them, both in one pass per round."""
    walk = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("n")))
    out = walk.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    walk = scratch.put("walk", walk.join(out, ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")))
    base = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("part"))
    if walk.limit(1).count() == 0:
        return base.withColumnRenamed("part", "rank")
    rank = seeds.withColumnRenamed("seed", "rank")

    def step(rank: DataFrame) -> DataFrame:
        moved = rank.join(walk, ["host", "kind"]).select(
            F.col("dst").alias("host"), "kind", (F.col("rank") * F.col("share") * damping).alias("part"))
        return base.unionByName(moved)

    total = F.sum("part").alias("rank")
    for i in range(rounds or 0):
        rank = step(rank).groupBy("host", "kind").agg(total)
        if i % 3 == 2:
            rank = scratch.put(f"rank-{i}", rank)
    i, more = 0, rounds is None
    while more:
        for _ in range(LOOK - 1):
            rank = step(rank).groupBy("host", "kind").agg(total)
        rank = scratch.put(f"before-{i}", rank)
        was = rank.select("host", "kind", F.lit(0.0).alias("part"), F.col("rank").alias("was"))
        rank = scratch.put(f"rank-{i}", step(rank).withColumn("was", F.lit(0.0)).unionByName(was)
                           .groupBy("host", "kind").agg(total, F.sum("was").alias("was")))
        # below 1e-300 doubles lose their digits
        moving = (F.abs(F.col("rank") - F.col("was")) > F.col("rank") * TOLERANCE) & (F.col("rank") > 1e-300)
        more = rank.filter(moving).limit(1).count() > 0
        rank = rank.drop("was")
        scratch.drop(f"before-{i}", f"rank-{i - 1}")
        i += 1
    return rank


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO, damping: float = DAMPING,
          rounds: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page."""
    sc = Scratch(pages.sparkSession, "url-filter")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "_verdict": verdict})
    links = sc.put("links", host_links(pages))
    kind = F.when(F.col("_verdict") == "allow", "trust").otherwise("distrust").alias("kind")
    count = judged.filter("_verdict IS NOT NULL").groupBy("host", kind).agg(F.count(F.lit(1)).alias("n"))
    count = sc.put("seeds", count)
    total = count.groupBy("kind").agg(F.sum("n").alias("total"))                # two rows
    seeds = count.join(F.broadcast(total), "kind").select(
        "host", "kind", (F.col("n") / F.col("total")).alias("seed"))
    rank = propagate(seeds, links, sc, damping, rounds)
    of = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
          for k in ("trust", "distrust")}
    blocked = sc.put("blocked", rank.groupBy("host").agg(of["trust"].alias("t"), of["distrust"].alias("d"))
                     .filter(F.col("d") > F.lit(ratio * (1 + EQUAL)) * F.col("t"))
                     .select("host", F.lit("block").alias("_host_verdict")))
    size = blocked.agg(F.sum(F.octet_length("host") + 32)).first()[0] or 0
    return (judged.join(F.broadcast(blocked) if size <= BROADCAST_BYTES else blocked, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("_verdict", "_host_verdict", F.lit("allow")).alias("verdict")))


def oracle_sql(rules=RULES, ratio: float = RATIO, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """The same in SQL: rounds are unrolled."""
    href = HREF.replace("'", "''")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'"
        for v, h, p in ordered) + " END"
    steps = "".join(f""",
r{i + 1} AS MATERIALIZED (SELECT host, kind, sum(part) AS rank FROM (
  SELECT host, kind, seed * (1 - {damping}) AS part FROM seeds UNION ALL
  SELECT walk.dst, r{i}.kind, r{i}.rank * walk.share * {damping} FROM r{i}
  JOIN walk ON walk.kind = r{i}.kind AND walk.src = r{i}.host) AS x{i} GROUP BY host, kind)"""
                    for i in range(rounds))
    return f"""
WITH p AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{URL}', 2) AS path
  FROM pages),
j AS (SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
      {case(lambda v, h, p: v)} AS v FROM p),
l AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{href}', 1))),
                                  '{UPPER}', '{LOWER}') AS dst FROM p) AS e
  WHERE src <> '' AND src <> dst GROUP BY src, dst),
w AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
walk AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM w),
c AS (SELECT host, CASE v WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n
      FROM j WHERE v IS NOT NULL GROUP BY 1, 2),
seeds AS (SELECT host, kind, n / sum(n) OVER (PARTITION BY kind) AS seed FROM c),
r0 AS (SELECT host, kind, seed AS rank FROM seeds){steps},
blocked AS (
  SELECT host FROM r{rounds} GROUP BY host
  HAVING round(coalesce(sum(rank) FILTER (kind = 'distrust'), 0), 12)
       > {ratio} * round(coalesce(sum(rank) FILTER (kind = 'trust'), 0), 12))
SELECT page_id, j.host, path, rule,
       coalesce(v, CASE WHEN blocked.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN blocked ON blocked.host = j.host"""

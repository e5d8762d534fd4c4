"""Secrets in texts, with DataFrame functions only.

Base kinds (leftmost, non-overlapping per kind):
*   ``assign``: a secret's name, ``:`` or ``=``, and a value of 12 or more characters;
*   ``access``: ``AKIA`` and capitals or digits, 18 or more characters;
*   ``hex``: 16 or more of ``0-9a-f``.
The method adds ``markov`` spans: runs of token characters that hold a letter, 12 or
more long, outside base spans, that a character Markov model of random strings
explains better than one of ordinary identifiers. (A run without a letter is a number.)
The log-likelihood ratio must
reach ``min_ratio``, and ``min_mean`` per character pair. Both models are first-order chains
over ``ALPHABET``, counted from labelled samples over all documents: the secret values that
the base kinds find, and ordinary identifiers, that is words, numbers, dates, paths and the
like: up to 16 parts of letters only or digits only between single ``-``, ``_`` or ``/``, 6 to
64 characters together. Only counted samples and counts of character pairs are shuffled for it. A pair's
probability is its share after its first character, drawn towards the second character's
share in the class, and that towards an even share; both by fixed shares of the class, so the
model does not depend on how often a table holds the same samples. Without samples of both
classes no span is added. ``held_out`` gives the scores of labelled samples that the models
have not seen.

Positions follow from lengths: the text between matches (``split``) and the
matches (``regexp_extract_all``) of one expression alternate, so running sums of
their code points give start and end. Only matches are shuffled.

A null text is empty and has no span; repeated rows are scanned alike, each for
itself; a null doc_id is kept. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch

MIN_LENGTH = 12
MIN_RATIO = 8.0
MIN_MEAN = 0.25
#: Weight of the second character's share against the mean weight of a first character,
#: and of the even share against the class.
BACKOFF, EVEN = 1.0, 0.05

# The base expressions, and the letters of the models.
NAMES = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
EDGE = "(?<![A-Za-z0-9+/_=-])"
RUN = EDGE + "(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{12,}+"
RUN_SCREEN = "[A-Za-z0-9+/_=-]{12}"
PART = r"(?:v?[0-9]++|[A-Za-z]++)"
ORDINARY = EDGE + rf"{PART}(?:[-_/]{PART}){{0,15}}+(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")


def _found(kind: int, text: Column, pattern: str, screen: str, value: int, min_value: int) -> Column:
    """The matches of one kind as array<struct<kind, i, gap, len, value>>; the value is null
    where it is shorter than ``min_value``."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    lens = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.char_length)
    vals = F.regexp_extract_all(text, p, F.lit(value))
    rows = F.transform(F.arrays_zip(gaps.alias("g"), lens.alias("l"), vals.alias("v")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), x["g"].alias("gap"), x["l"].alias("len"),
        F.when(F.char_length(x["v"]) >= min_value, x["v"]).alias("value")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:string>>")
    # the piece after the last match has no match of its own
    return F.when(text.rlike(screen), F.filter(rows, lambda x: x["len"].isNotNull())).otherwise(none)


def raw_matches(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``row, doc_id, m``: a number for each row of ``docs`` and its matches of all
    kinds. Row numbers hold for one evaluation only: write this before use."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(
        _found(0, t, ASSIGN, NAMES, 2, 12), _found(1, t, ACCESS, ACCESS, 0, 0),
        _found(2, t, HEX, HEX, 0, 0), _found(3, t, RUN, RUN_SCREEN, 0, min_length)).alias("m"))


def placed(raw: DataFrame) -> DataFrame:
    """``row, kind, start, end, value`` of raw matches: base spans and candidate runs."""
    flat = raw.select("row", F.explode("m").alias("m")).select("row", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(
        Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return (flat.withColumn("end", end).filter("value IS NOT NULL")
            .select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value"))


def _pairs(value: Column) -> Column:
    """Neighbouring characters of a string."""
    chars, n = F.split(value, ""), F.char_length(value) - 1
    return F.when(n > 0, F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))) \
        .otherwise(F.array().cast("array<string>"))


def ordinary(rows: DataFrame) -> DataFrame:
    """``value``: the ordinary identifiers in ``text``, with repeats."""
    n = F.char_length("value")
    return rows.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("value")) \
        .filter((n >= 6) & (n <= 64))


def train(found: DataFrame, rows: DataFrame, backoff: float = BACKOFF, even: float = EVEN) -> DataFrame:
    """``pair, ratio``: log P(second | first) among random strings less that among
    ordinary identifiers, for every pair of the alphabet (a table of fixed size)."""
    both = found.filter("kind < 3").select(F.lit(1).alias("rand"), "value").union(
        ordinary(rows).select(F.lit(0).alias("rand"), "value"))
    # equal samples first: their pairs are cut once
    counts = (both.groupBy("rand", "value").agg(F.count(F.lit(1)).alias("n"))
              .select("rand", "n", F.explode(_pairs(F.col("value"))).alias("pair"))
              .groupBy("pair").agg(F.sum(F.col("rand") * F.col("n")).alias("r"),
                                   F.sum((1 - F.col("rand")) * F.col("n")).alias("o")))
    letters = rows.sparkSession.range(1).select(F.explode(F.split(F.lit(ALPHABET), "")).alias("a"))
    grid = letters.select("a", F.explode(F.split(F.lit(ALPHABET), "")).alias("b")) \
        .select("a", "b", F.concat("a", "b").alias("pair"))
    cell = grid.join(counts, "pair", "left").select(
        "a", "b", "pair", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    trained = Window.partitionBy(F.lit(1))         # one window over the fixed grid
    cell = cell.withColumns({"nr": F.sum("r").over(trained), "no": F.sum("o").over(trained)}).filter("nr > 0 AND no > 0")
    first, second, k = Window.partitionBy("a"), Window.partitionBy("b"), float(len(ALPHABET))

    def logp(c: str) -> Column:
        n = F.col(f"n{c}")
        share = (F.sum(c).over(second) / n + even / k) / (1 + even)
        weight = n * (backoff / k)
        return F.log((F.col(c) + weight * share) / (F.sum(c).over(first) + weight))

    return cell.select("pair", (logp("r") - logp("o")).alias("ratio"))


def score(values: DataFrame, model: DataFrame) -> DataFrame:
    """The columns of ``values`` but ``value``, with ``s`` and ``m``: the log-likelihood
    ratio of the value and its mean over the pairs. Rows are told apart by those columns."""
    keys = [c for c in values.columns if c != "value"]
    return (values.select(*keys, F.explode(_pairs(F.col("value"))).alias("pair"))
            .join(F.broadcast(model), "pair")          # len(ALPHABET)**2 rows at most
            .groupBy(*keys).agg(F.sum("ratio").alias("s"), F.avg("ratio").alias("m")))


def judged_random(min_ratio: float = MIN_RATIO, min_mean: float = MIN_MEAN) -> Column:
    return (F.round("s", 6) >= min_ratio) & (F.round("m", 6) >= min_mean)


def held_out(docs: DataFrame) -> DataFrame:
    """``rand, value_id, n, s, m``: scores of the labelled samples with a letter and 12 or more
    characters whose values fall into a quarter by hash; the models see the other values."""
    sc = Scratch(docs.sparkSession, "secret-held-out")
    found = sc.put("found", placed(sc.put("raw", raw_matches(docs)))).filter("kind < 3").select("kind", "value")
    words = ordinary(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    out = F.pmod(F.xxhash64("value"), F.lit(4)) == 0
    model = sc.put("model", train(found.filter(~out), words.filter(~out).withColumnRenamed("value", "text")))
    both = found.select(F.lit(1).alias("rand"), "value").union(words.select(F.lit(0), "value"))
    seen = both.filter(out & F.col("value").rlike(RUN)).groupBy("rand", "value").agg(F.count(F.lit(1)).alias("n"))
    seen = sc.put("samples", seen.withColumn("value_id", F.xxhash64("value")))
    return score(seen.select("rand", "value_id", "n", "value"), model)


def scan(docs: DataFrame, min_ratio: float = MIN_RATIO, min_mean: float = MIN_MEAN) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov`` per row of ``docs``."""
    sc = Scratch(docs.sparkSession, "secret-scan")
    raw = sc.put("raw", raw_matches(docs))
    found, ids = sc.put("found", placed(raw)), raw.select("row", "doc_id")
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = sc.put("model", train(found, text))

    # a candidate run must lie clear of the base spans around it
    base_end = F.when(F.col("kind") < 3, F.col("end"))
    base_start = F.when(F.col("kind") < 3, F.col("start"))
    up, down = (Window.partitionBy("row").orderBy(o("start")).rangeBetween(Window.unboundedPreceding, 0)
                for o in (F.asc, F.desc))
    near = found.withColumns({"before": F.max(base_end).over(up), "after": F.min(base_start).over(down)})
    runs = near.filter("kind = 3 AND coalesce(before <= start, true) AND coalesce(after >= end, true)")
    scored = score(runs.select("row", "start", "end", "value"), model).filter(judged_random(min_ratio, min_mean))
    spans = found.filter("kind < 3").select("row", "kind", "start", "end").unionByName(
        scored.select("row", F.lit(3).alias("kind"), "start", "end"))
    one = F.struct("start", "kind", "end")
    name = F.array(*[F.lit(k) for k in KINDS])
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(
        ":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    per = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sort_array(F.collect_list(one)).alias("a"))
    out = ids.join(per, "row", "left")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    a = F.coalesce("a", empty)
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(join(F.filter(a, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        join(a).alias("spans"), F.coalesce("n_markov", F.lit(0)).alias("n_markov"))

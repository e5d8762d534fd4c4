"""Reproducible row splits.

``randomSplit`` draws per partition, so the same seed gives different sets
after a repartition or a different file layout. The default here is a hash
split: a row's part depends only on ``md5(salt:key...)``, so every executor,
every layout, and any SQL engine with ``md5`` puts it in the same part. It is
a narrow, per-row expression — no shuffle, no sampling job.

Rows that share a key always land in the same part (no leakage of one key
across parts); a null key part is skipped by ``concat_ws``, so rows whose key
is entirely null share one part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import split_bucket, split_digest
from cohortlab.operators.broadcast import bounded_broadcast

HEX_WIDTH = 8

# The reference's split weights and seed (the seed is used as
# the hash salt here, and as the seed of ``random_split``).
WEIGHTS = (0.8, 0.2)
SEED = "12345"


def thresholds(weights: Sequence[float], width: int = HEX_WIDTH) -> list[str]:
    """Upper bounds (hex strings) of every part but the last."""
    if not weights or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    total, acc, out = float(sum(weights)), 0.0, []
    for w in weights[:-1]:
        acc += w / total
        out.append(format(min(int(acc * 16 ** width), 16 ** width - 1), f"0{width}x"))
    return out


def _assign(bucket: Column, weights: Sequence[float], names: Sequence[str]) -> Column:
    e = None
    for t, n in zip(thresholds(weights), names[:-1]):
        e = F.when(bucket < F.lit(t), F.lit(n)) if e is None else e.when(bucket < F.lit(t), F.lit(n))
    return F.lit(names[-1]) if e is None else e.otherwise(F.lit(names[-1]))


def hash_split(df: DataFrame, key_cols: Sequence[str], weights: Sequence[float] = WEIGHTS,
               salt: str = SEED, names: Sequence[str] = ("train", "test"),
               out: str = "split") -> DataFrame:
    """Add ``out`` naming the part of each row (R1): the first 8 hex digits of
    md5(salt:key) against the cumulative weights."""
    if len(names) != len(weights):
        raise ValueError("one name per weight")
    return df.withColumn(out, _assign(split_bucket(key_cols, salt, HEX_WIDTH), weights, names))


def three_way_split(df: DataFrame, key_cols: Sequence[str],
                    weights: Sequence[float] = WEIGHTS, salt: str = SEED,
                    out: str = "split") -> DataFrame:
    """train / val / test as the reference does it: split off test, then split
    the training part again with the same weights (R1 + R2; 64 / 16 / 20 %).

    One md5 per row: digits 1-8 decide test vs the rest (the same rows as
    ``hash_split`` with this salt), digits 9-16 decide val vs train.
    """
    h = "_split_md5"
    d = df.withColumn(h, split_digest(key_cols, salt))
    first = _assign(F.substring(F.col(h), 1, HEX_WIDTH), weights, ("rest", "test"))
    second = _assign(F.substring(F.col(h), 1 + HEX_WIDTH, HEX_WIDTH), weights, ("train", "val"))
    return (d.withColumn(out, F.when(first == F.lit("test"), F.lit("test")).otherwise(second))
            .drop(h))


#: Hex digits by which ``exact_split`` narrows a class's bound in each round.
DIGITS = 3


def exact_split(df: DataFrame, key_cols: Sequence[str], class_col: str, share: float = WEIGHTS[0],
                salt: str = SEED, names: Sequence[str] = ("train", "test"), out: str = "split") -> DataFrame:
    """Split with exactly ``floor(share * n)`` rows of every class in the first part.

    A class's first part holds its rows of smallest digest. The bound is found without
    sorting a class: a round counts the class's rows by the next three hex digits, at most
    4096 counts a class, keeps the prefix in which the bound lies and goes on inside it;
    a class is done once its prefix ends on a row bound. So a class with a third of all
    rows costs partial counts, as any other. Rows of one key share a digest and stay
    together; with repeated keys a class may therefore fall short of its share by those.
    A null class is a class of its own."""
    h, prefix = "_split_md5", "_split_prefix"
    cls = F.struct(F.col(class_col)).alias("_class")        # a null class meets itself in the joins
    rows = df.select(F.to_json(cls).alias("_class"), split_digest(key_cols, salt).alias(h))
    state = (rows.groupBy("_class").agg(F.floor(F.count(F.lit(1)) * F.lit(share)).cast("long").alias("_need"))
             .select("_class", F.lit("").alias(prefix), "_need", (F.col("_need") == 0).alias("_done")))
    for r in range(1, -(-32 // DIGITS) + 1):
        state = bounded_broadcast(state)
        if not state.filter(~F.col("_done")).head(1):
            break
        last = r * DIGITS >= 32
        open_ = state.filter(~F.col("_done"))
        here = (rows.join(open_, "_class").filter(F.col(h).startswith(F.col(prefix)))
                .groupBy("_class", "_need", F.substring(h, 1, r * DIGITS).alias(prefix))
                .agg(F.count(F.lit(1)).alias("n")))
        order = Window.partitionBy("_class").orderBy(prefix)       # at most 4096 counts a class
        cum = here.withColumn("_upto", F.sum("n").over(order))
        reached = cum.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("n") < F.col("_need")))
        left = F.col("_need") - (F.col("_upto") - F.col("n"))
        whole = left == F.col("n")
        # rows of one digest cannot be parted: the bound then lies before them
        found = reached.select("_class", F.when(whole | F.lit(not last), F.col(prefix)).otherwise(
            F.concat(F.expr(f"substring({prefix}, 1, 31)"), F.lit(" "))).alias(prefix),
            left.alias("_need"), (whole | F.lit(last)).alias("_done"))
        state = state.filter("_done").unionByName(found)
    bound = state.select("_class", F.col(prefix).alias("_bound"))
    first = (F.col("_bound") != "") & (F.substring(F.col(h), F.lit(1), F.length("_bound")) <= F.col("_bound"))
    return (df.withColumn("_class", F.to_json(cls)).withColumn(h, split_digest(key_cols, salt))
            .join(bounded_broadcast(bound), "_class", "left")
            .withColumn(out, F.when(first, F.lit(names[0])).otherwise(F.lit(names[1])))
            .select(*[F.col(c) for c in df.columns if c != out], out))


def split_frames(df: DataFrame, col: str = "split", names: Sequence[str] | None = None,
                 drop: bool = True) -> dict[str, DataFrame]:
    """One lazy filtered frame per part (each filter is pushed to the scan)."""
    names = names or ("train", "val", "test")
    return {n: (df.filter(F.col(col) == n).drop(col) if drop else df.filter(F.col(col) == n))
            for n in names}


def random_split(df: DataFrame, weights: Sequence[float] = WEIGHTS,
                 seed: int = int(SEED)) -> list[DataFrame]:
    """The reference's ``randomSplit`` (layout-dependent; kept as an option)."""
    return df.randomSplit(list(weights), seed=seed)

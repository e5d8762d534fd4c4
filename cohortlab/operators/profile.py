"""Class profiling: null checks, label encoding, column families, record lookup,
summary statistics per class, and the scaled position of a record or a class
average inside a class range.

The reference answers these with one driver round trip per value (each a
separate scan). Here every statistic of every class and column comes out of a
single ``groupBy(label).agg(...)``: partial aggregation on the map side, so each
task ships at most one row per class, whatever the skew between classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import (contains, encode_binary, min_max_scale,
                                         null_count, null_heavy, qcol)
from cohortlab.operators.broadcast import DEFAULT_MAX_ROWS, bounded_broadcast, fits_broadcast, measured
from cohortlab.operators.keys import join_null_safe
from cohortlab.session import shared_dir
from cohortlab.sources.cache import cut_lineage

# The attribute order of the reference's radar charts (one family
# of the ten nucleus measurements), used by ``radar_table`` for that schema.
RADAR_ORDER = ("fractal_dimension", "texture", "perimeter", "area", "smoothness",
               "concavity", "concave_points", "symmetry", "compactness", "radius")

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [n for n, t in df.dtypes
            if n not in ex and (t in _NUMERIC or t.startswith("decimal"))]


def feature_columns(df: DataFrame, non_feature: Iterable[str]) -> list[str]:
    """Every column except ``non_feature``, in table order."""
    ex = set(non_feature)
    return [c for c in df.columns if c not in ex]


# ---------------------------------------------------------------- P1, P2, P3

def with_null_count(df: DataFrame, cols: Sequence[str] | None = None,
                    out: str = "null_count") -> DataFrame:
    """Add the per-row number of nulls over ``cols`` (default: all columns)."""
    cols = list(cols) if cols is not None else list(df.columns)
    return df.withColumn(out, null_count(cols))


def drop_null_heavy_rows(df: DataFrame, cols: Sequence[str] | None = None,
                         frac: float = 0.9) -> DataFrame:
    """Keep rows where fewer than ``frac`` of ``cols`` are null."""
    cols = list(cols) if cols is not None else list(df.columns)
    return df.filter(~null_heavy(cols, frac))


def encode_label(df: DataFrame, col: str, positive, out: str = "label",
                 null_label: str = "zero") -> DataFrame:
    """Binary label column: 1 for ``positive``, else 0."""
    return df.withColumn(out, encode_binary(col, positive, null_label))


# ---------------------------------------------------------------- P4-P8

def project_family(df: DataFrame, suffix: str, lead: Sequence[str] = ()) -> DataFrame:
    """``lead`` columns plus every column whose name ends with ``suffix``."""
    fam = [c for c in df.columns if c.endswith(suffix) and c not in lead]
    return df.select(*lead, *fam)


def class_subset(df: DataFrame, col: str, value: str) -> DataFrame:
    """Rows whose class value contains ``value`` (P7); a null class is dropped."""
    return df.filter(contains(col, value))


_RANGE_TYPES = ("tinyint", "smallint", "int", "bigint", "date", "string")


def _within_keys(df: DataFrame, keys: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``df`` filtered to the span of the keys, which the scan uses to skip row
    groups. Only for types whose string form casts back to the same value, and
    only where no key part is null (a null key matches null rows)."""
    same = [c for c in ids if dict(df.dtypes)[c] in _RANGE_TYPES
            and dict(keys.dtypes)[c] == dict(df.dtypes)[c]]
    if not same:
        return df
    aggs = []
    for i, c in enumerate(same):
        x = qcol(c)
        aggs += [F.min(x).cast("string").alias(f"lo{i}"), F.max(x).cast("string").alias(f"hi{i}"),
                 F.count_if(x.isNull()).alias(f"null{i}")]
    r = keys.agg(*aggs).first()
    for i, c in enumerate(same):
        if r[f"lo{i}"] is not None and not r[f"null{i}"]:
            t = dict(df.dtypes)[c]
            df = df.filter((qcol(c) >= F.lit(r[f"lo{i}"]).cast(t)) & (qcol(c) <= F.lit(r[f"hi{i}"]).cast(t)))
    return df


def _filtered_lookup(df: DataFrame, keys: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``point_lookup`` for distinct keys that no broadcast holds.

    The keys are kept as Parquet, so their size is known to the planner, and joined by plain
    equality: Spark then builds a Bloom filter of them (``session.lookup_settings``) and
    drops most rows without a key before the shuffle; the semi join after it is exact. Keys with
    a null part, which no equality finds, are joined null-safe with the rows that have one.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "lookup-keys")
    keys.write.parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    has_null = reduce(lambda a, b: a | b, [qcol(c).isNull() for c in ids])
    known = keys.filter(~has_null)
    out = _within_keys(df, known, ids).join(known, list(ids), "left_semi")
    if keys.filter(has_null).limit(1).count():
        out = out.unionByName(join_null_safe(df.filter(has_null), keys.filter(has_null), ids, how="left_semi"))
    return out


def point_lookup(df: DataFrame, id_cols, keys, cols: Sequence[str] | None = None,
                 expect_one: bool = False, max_broadcast_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Rows whose key is one of ``keys``.

    ``id_cols`` is one column name or a list (composite key). ``keys`` is a
    scalar or list of scalars for a one-column key (pushed to the scan as an
    ``IN`` filter), or a DataFrame holding the key columns (left-semi join at
    every size, null-safe as in the per-class lookups of ``record_profile``; the
    key table is broadcast only after its size is checked and up to
    ``max_broadcast_rows``, beyond that a Bloom filter of the keys thins the rows
    before the shuffle; the span of integer, date and string keys is pushed to
    the scan). Returns 0..n rows per key; ``expect_one=True`` raises unless every key matches exactly one row.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    if isinstance(keys, DataFrame):
        k, n, size = measured(keys.select(*ids).distinct())
        if fits_broadcast(k, n, max_broadcast_rows, size):
            out = join_null_safe(_within_keys(df, k, ids), F.broadcast(k), ids, how="left_semi")
        else:
            out = _filtered_lookup(df, k, ids)
    else:
        if len(ids) != 1:
            raise ValueError("scalar keys need a one-column key; pass a DataFrame of keys")
        vals = list(keys) if isinstance(keys, (list, tuple, set)) else [keys]
        known = [v for v in vals if v is not None]
        cond = F.col(ids[0]).isin(known)
        if len(known) < len(vals):  # a null key matches null, as with a key table
            cond = cond | F.col(ids[0]).isNull()
        out = df.filter(cond)
        k = None
    if cols is not None:
        out = out.select(*ids, *[c for c in cols if c not in ids])
    if expect_one:
        out = cut_lineage(out)   # checked and returned rows are the same rows, read once
        per_key = out.groupBy(*ids).count()
        if k is None:
            dtype = df.schema[ids[0]].dataType
            k = df.sparkSession.range(1).select(
                F.explode(F.array(*[F.lit(v).cast(dtype) for v in vals])).alias(ids[0]))
        bad = (join_null_safe(k, per_key, ids, how="left")
               .filter(F.coalesce(F.col("count"), F.lit(0)) != 1).limit(1).count())
        if bad:
            raise ValueError(f"point_lookup: a key of {ids} does not match exactly one row")
    return out


# ---------------------------------------------------------------- A1

def describe_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample stddev, min and max of every column, each read once (A1).

    As in the reference's summary, strings have a count, a least and a greatest
    value and no mean or deviation. Output: ``attribute string, n long, mean,
    stddev, min_value, max_value double, min_text, max_text string``; the text
    forms hold the bounds of columns that are not numbers.
    """
    cols = list(cols) if cols is not None else list(df.columns)
    number = set(numeric_columns(df))
    # text bounds make Spark sort for the whole aggregate: numbers keep their hash aggregate
    # in one of their own, and each of the two reads its columns only
    kinds = [[c for c in cols if (c in number) == n] for n in (True, False)]
    parts = [_described(df, k, k is kinds[0]) for k in kinds if k]
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def _described(df: DataFrame, cols: Sequence[str], is_number: bool) -> DataFrame:
    aggs, rows = [], []
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        x = qcol(c)
        aggs += [F.count(x).alias(f"_n{i}"), F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
        if is_number:
            aggs += [F.avg(x.cast("double")).alias(f"_a{i}"), F.stddev_samp(x.cast("double")).alias(f"_s{i}")]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        rows.append(F.struct(
            F.lit(c).alias("attribute"), F.col(f"_n{i}").alias("n"),
            (F.col(f"_a{i}") if is_number else none).alias("mean"),
            (F.col(f"_s{i}") if is_number else none).alias("stddev"),
            (lo.cast("double") if is_number else none).alias("min_value"),
            (hi.cast("double") if is_number else none).alias("max_value"),
            (nothing if is_number else lo.cast("string")).alias("min_text"),
            (nothing if is_number else hi.cast("string")).alias("max_text")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def describe_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample stddev, min and max per numeric column, one scan (A1).

    Output: ``attribute string, n long, mean, stddev, min_value, max_value double``.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(F.col(c)).alias(f"_n{i}"), F.avg(x).alias(f"_a{i}"),
                 F.stddev_samp(x).alias(f"_s{i}"), F.min(x).alias(f"_lo{i}"),
                 F.max(x).alias(f"_hi{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"_n{i}").alias("n"),
                              F.col(f"_a{i}").alias("mean"), F.col(f"_s{i}").alias("stddev"),
                              F.col(f"_lo{i}").alias("min_value"),
                              F.col(f"_hi{i}").alias("max_value"))
                     for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def describe_table(df: DataFrame) -> DataFrame:
    """Spark's own ``describe()`` over every column, all values as strings."""
    return df.describe()


# ---------------------------------------------------------------- A2-A4

def class_stats(df: DataFrame, label_col: str, cols: Sequence[str]) -> DataFrame:
    """avg / min / max of every column per class in one aggregate (A2-A4).

    Output (long): ``label_col, attribute, n long, avg_value, min_value,
    max_value double``; ``n`` counts the non-null values of the attribute.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(F.col(c)).alias(f"_n{i}"), F.avg(x).alias(f"_a{i}"),
                 F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    wide = df.groupBy(label_col).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"_n{i}").alias("n"),
                              F.col(f"_a{i}").alias("avg_value"),
                              F.col(f"_lo{i}").alias("min_value"),
                              F.col(f"_hi{i}").alias("max_value"))
                     for i, c in enumerate(cols)])
    return wide.select(F.col(label_col), F.inline(rows))


def _unpivot_values(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"),
                              F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.inline(rows))


# ---------------------------------------------------------------- F1-F3

def record_profile(df: DataFrame, id_cols, label_col: str, cols: Sequence[str],
                   keys, stats: DataFrame | None = None) -> DataFrame:
    """Scaled position of looked-up records inside their own class range (F2).

    ``keys`` holds the record keys; when it also carries ``label_col`` the
    lookup is made within that class (as the reference looks a record up in
    its class view). ``stats`` is a ``class_stats`` frame (computed over
    ``df`` when omitted); it has one row per class and attribute, so it is
    broadcast after a size check and the record rows never shuffle.

    Output: ``id_cols, label_col, attribute, value, min_value, max_value, scaled``.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    stats = stats if stats is not None else class_stats(df, label_col, cols)
    look = ids + [label_col] if (isinstance(keys, DataFrame) and label_col in keys.columns) else ids
    recs = point_lookup(df, look, keys, cols=[label_col, *cols])
    long = _unpivot_values(recs, [*ids, label_col], cols)
    st = bounded_broadcast(stats.select(label_col, "attribute", "min_value", "max_value"))
    return (join_null_safe(long, st, [label_col, "attribute"], how="left")
            .withColumn("scaled", min_max_scale("value", "min_value", "max_value")))


def scale_by_class(df: DataFrame, label_col: str, cols: Sequence[str],
                   suffix: str = "_scaled", stats: DataFrame | None = None) -> DataFrame:
    """Min-max scale every row by its own class range, wide form (F1 over a table).

    The per-class ranges are one small row per class, joined by a size-checked
    broadcast: no shuffle of the rows, unlike a window partitioned by class
    (which would put a hot class into one task).
    """
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"_lo_{c}"),
                 F.max(F.col(c).cast("double")).alias(f"_hi_{c}")]
    ranges = df.groupBy(label_col).agg(*aggs) if stats is None else (
        stats.groupBy(label_col).pivot("attribute", list(cols))
        .agg(F.first("min_value").alias("lo"), F.first("max_value").alias("hi"))
        .select(label_col, *[F.col(f"{c}_lo").alias(f"_lo_{c}") for c in cols],
                *[F.col(f"{c}_hi").alias(f"_hi_{c}") for c in cols]))
    r = bounded_broadcast(ranges)
    out = join_null_safe(df, r, [label_col], how="left")
    return out.select(*[qcol(c) for c in df.columns],
                      *[min_max_scale(c, f"_lo_{c}", f"_hi_{c}").alias(c + suffix)
                        for c in cols])


def baseline_profile(stats: DataFrame, label_col: str, scale_by: str = "own_class",
                     baseline_class=None) -> DataFrame:
    """Scaled position of each class average inside a class range.

    ``scale_by="own_class"`` uses the class's own range (the reference's
    baseline); ``"baseline_class"`` scales every class average by the range of
    ``baseline_class``. Input and output are small (one row per class and
    attribute).
    """
    if scale_by == "own_class":
        out = stats
    elif scale_by == "baseline_class":
        if baseline_class is None:
            raise ValueError("baseline_class is required for scale_by='baseline_class'")
        base = (stats.filter(F.col(label_col) == F.lit(baseline_class))
                .select("attribute", "min_value", "max_value"))
        out = stats.drop("min_value", "max_value").join(base, on="attribute", how="left")
    else:
        raise ValueError("scale_by must be 'own_class' or 'baseline_class'")
    return (out.withColumn("scaled_avg", min_max_scale("avg_value", "min_value", "max_value"))
            .select(label_col, "attribute", "avg_value", "min_value", "max_value", "scaled_avg"))


def radar_table(baseline: DataFrame, records: DataFrame, label_col: str,
                families: dict[str, Sequence[str]], baseline_class,
                record_classes: Sequence) -> DataFrame:
    """Long table under the reference's radar charts.

    One row per family and attribute, in the given order (``pos`` from 1):
    the baseline class's scaled average and, per class in ``record_classes``,
    the scaled record value (mean of the looked-up records of that class).
    """
    fam_rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(i + 1).alias("pos"),
                                  F.lit(a).alias("attribute"))
                         for f, attrs in families.items() for i, a in enumerate(attrs)])
    base = (baseline.filter(F.col(label_col) == F.lit(baseline_class))
            .select("attribute", F.col("scaled_avg").alias("baseline")))
    rec = (records.groupBy("attribute").pivot(label_col, list(record_classes))
           .agg(F.avg("scaled")))
    rec = rec.select("attribute", *[qcol(str(c)).alias(f"record_{c}") for c in record_classes])
    order = baseline.sparkSession.range(1).select(F.inline(fam_rows))
    return (order.join(bounded_broadcast(base), on="attribute", how="left")
            .join(bounded_broadcast(rec), on="attribute", how="left")
            .select("family", "pos", "attribute", "baseline",
                    *[f"record_{c}" for c in record_classes]))


def class_profile(df: DataFrame, label_col: str, cols: Sequence[str]) -> DataFrame:
    """Minimum slice: per class and attribute, avg/min/max and where the
    average lies in the class range — one scan, one aggregate."""
    st = class_stats(df, label_col, cols)
    return st.withColumn("scaled_avg", min_max_scale("avg_value", "min_value", "max_value"))

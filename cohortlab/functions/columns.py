"""Column expressions shared by the operators.

Everything here builds a ``Column`` out of built-in Spark functions, so it runs
inside whole-stage codegen on the executors; there is no Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name as a quoted identifier (dots and backticks kept literal)."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col(quoted(name))


def null_count(cols: Sequence[str]) -> Column:
    """Number of nulls among ``cols`` in the row (P2). Works for any column types."""
    if not cols:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def null_heavy(cols: Sequence[str], frac: float = 0.9) -> Column:
    """True when at least ``frac`` of ``cols`` are null in the row (P1's test);
    false when ``cols`` is empty."""
    if not cols:
        return F.lit(False)
    return null_count(cols) >= F.lit(float(frac) * len(cols))


def encode_binary(c: str | Column, positive, null_label: str = "zero") -> Column:
    """1 where the value equals ``positive``, else 0.

    ``null_label="zero"`` maps a null class to 0 like the reference's
    ``when(...).otherwise(0)``; ``"keep"`` leaves it null.
    """
    x = col(c)
    e = F.when(x == F.lit(positive), F.lit(1)).otherwise(F.lit(0))
    if null_label == "keep":
        e = F.when(x.isNull(), F.lit(None).cast("int")).otherwise(e)
    elif null_label != "zero":
        raise ValueError("null_label must be 'zero' or 'keep'")
    return e


def min_max_scale(x: str | Column, mn: str | Column, mx: str | Column) -> Column:
    """(x - min) / (max - min), not clamped (F1). A zero range gives null."""
    return F.try_divide(col(x) - col(mn), col(mx) - col(mn))


def contains(c: str | Column, value: str) -> Column:
    """Substring test (F5); null input gives null, so a filter drops the row."""
    return col(c).contains(F.lit(value))


def negate(pred: Column) -> Column:
    """Logical not."""
    return ~pred


def match_flag(pred: str | Column, label: str | Column) -> Column:
    """1 where prediction equals label, else 0, null compares as not equal."""
    return F.when(col(pred) == col(label), F.lit(1)).otherwise(F.lit(0))


def all_of(conds: Sequence[Column]) -> Column:
    """Conjunction of predicates (P15's chained filters folded into one)."""
    if not conds:
        return F.lit(True)
    return reduce(lambda a, b: a & b, conds)


def split_digest(key_cols: Sequence[str], salt: str) -> Column:
    """md5 of ``salt:key...`` as 32 hex digits: a layout-independent hash that
    SQL engines reproduce (a null key part is skipped, as concat_ws does)."""
    parts = [F.lit(str(salt))] + [F.col(c).cast("string") for c in key_cols]
    return F.md5(F.concat_ws(":", *parts))


def split_bucket(key_cols: Sequence[str], salt: str, width: int = 8,
                 segment: int = 0) -> Column:
    """``width`` hex digits of the digest, from segment ``segment``: a uniform
    bucket; different segments of one digest are independent buckets."""
    return F.substring(split_digest(key_cols, salt), 1 + segment * width, width)

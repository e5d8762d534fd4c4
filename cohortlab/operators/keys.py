"""Joins on group keys that treat null as a key value, like ``groupBy`` does.

``groupBy`` puts rows with a null key into a group of their own; an equi join
(``on=[...]``) never matches null to null. Joining per-group results back to
rows therefore uses null-safe equality (``<=>``), which Spark still plans as a
hash or sort-merge equi join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import qcol, quoted


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` on ``keys`` (null matches null); the
    output has ``left``'s columns, then ``right``'s non-key columns."""
    if how not in ("left", "left_outer", "inner", "left_semi", "left_anti"):
        raise ValueError("join_null_safe keeps the left keys; use a left, inner or semi join")
    ren = {k: f"_rk_{i}" for i, k in enumerate(keys)}
    rest = [c for c in right.columns if c not in ren]
    lq = left.alias("_jl")
    rq = right.select(*[qcol(k).alias(ren[k]) for k in keys],
                      *[qcol(c) for c in rest]).alias("_jr")
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"_jl.{quoted(k)}").eqNullSafe(F.col(f"_jr.{ren[k]}")) for k in keys])
    joined = lq.join(rq, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*[F.col(f"_jl.{quoted(c)}") for c in left.columns],
                         *[F.col(f"_jr.{quoted(c)}") for c in rest])

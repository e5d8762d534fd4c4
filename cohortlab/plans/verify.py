"""Compare a Spark result with a DuckDB result as multisets.

Mirrors the contract check: columns are sorted by name, row counts must
agree, and the rows must agree as an order-free multiset (doubles compared
after rounding).
"""

from __future__ import annotations

import math
import os
from collections import Counter

from pyspark.sql import DataFrame

from cohortlab.plans.catalog import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if digits is None else round(v, digits) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), digits)
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x, digits) for x in v.tolist())
    return v


def compare(spark_df: DataFrame, con, sql: str, digits: int | None = 6) -> dict:
    """Return {'ok', 'spark_rows', 'oracle_rows', 'columns', 'detail'}.

    ``digits=None`` compares doubles bit for bit (after -0.0 -> 0.0)."""
    s_cols = sorted(spark_df.columns)
    s_rows = [tuple(_norm(r[c], digits) for c in s_cols) for r in spark_df.collect()]
    rel = con.sql(sql)
    o_cols_raw = rel.columns
    o_rows_raw = rel.fetchall()
    o_cols = sorted(o_cols_raw)
    idx = [o_cols_raw.index(c) for c in o_cols]
    o_rows = [tuple(_norm(r[i], digits) for i in idx) for r in o_rows_raw]
    res = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows), "columns": s_cols}
    if s_cols != o_cols:
        res.update(ok=False, detail=f"columns differ: spark={s_cols} oracle={o_cols}")
        return res
    cs, co = Counter(s_rows), Counter(o_rows)
    if cs == co:
        res.update(ok=True, detail="")
    else:
        only_s = list((cs - co).elements())[:3]
        only_o = list((co - cs).elements())[:3]
        res.update(ok=False, detail=f"spark-only {only_s} oracle-only {only_o}")
    return res


SPARK_WIDTH = {"tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64",
               "float": "f32", "double": "f64", "string": "str", "boolean": "bool"}
DUCK_WIDTH = {"TINYINT": "i8", "SMALLINT": "i16", "INTEGER": "i32", "BIGINT": "i64",
              "FLOAT": "f32", "DOUBLE": "f64", "VARCHAR": "str", "BOOLEAN": "bool"}


def type_diffs(df: DataFrame, con, sql: str) -> list:
    """Columns whose Spark type and DuckDB type differ in kind or width."""
    rel = con.sql(sql)
    duck = {c: DUCK_WIDTH.get(str(t).split("(")[0], str(t)) for c, t in zip(rel.columns, rel.types)}
    return [(c, t, duck.get(c)) for c, t in df.dtypes if SPARK_WIDTH.get(t, t) != duck.get(c)]

"""Named relations and SQL text over them.

``view_sql`` registers the given frames as temporary views and runs
parameterised SQL (named markers ``:name`` bound through ``args``, never
string concatenation of values). ``sql_over`` uses Spark's frame references
(``{name}`` in the text), which need no session-wide names at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_views(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def view_sql(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None,
             args: dict | None = None) -> DataFrame:
    register_views(views or {})
    return spark.sql(text, args=args) if args else spark.sql(text)


def sql_over(spark: SparkSession, text: str, args: dict | None = None,
             **frames: DataFrame) -> DataFrame:
    return spark.sql(text, args=args, **frames)

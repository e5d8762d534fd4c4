"""CSV source.

``read_csv`` mirrors the reference's ``header`` + ``inferSchema`` read; pass a
``schema`` in production, which skips the inference pass over the files and
pins the types. ``write_csv`` writes a table as CSV under the shared folder
(the cluster's checkpoint folder), never a machine-local one.

``TEXT_SAFE`` is the dialect that brings every text back as it was: values are
quoted where needed, quotes doubled, line ends allowed inside quotes, and a null (nothing
between the commas) kept apart from an empty string (two quotes). Spark does not
split a file with line ends inside quotes, so write many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cohortlab.session import shared_dir


# The options of the dialect.
TEXT_SAFE = {"quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "", "lineSep": "\n",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# on reading, what stands for "nothing between the commas" must differ from an empty string
_READ = {"multiLine": "true", "emptyValue": "", "nullValue": "\x00null"}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, infer_schema: bool = True,
             sampling_ratio: float | None = None, text_safe: bool = False,
             **options) -> DataFrame:
    """CSV with a header (in the ``TEXT_SAFE`` dialect with ``text_safe``). With ``schema`` no inference pass runs; otherwise
    types are inferred, from a ``sampling_ratio`` share of the rows if given
    (inference is a full extra pass over the files)."""
    r = spark.read.option("header", str(header).lower())
    for k, v in ({**TEXT_SAFE, **_READ, **options} if text_safe else options).items():
        r = r.option(k, v)
    if schema is not None:
        return r.schema(schema).csv(path)
    r = r.option("inferSchema", str(infer_schema).lower())
    if sampling_ratio is not None:
        r = r.option("samplingRatio", str(sampling_ratio))
    return r.csv(path)


def write_csv(df: DataFrame, path: str | None = None, header: bool = True,
              mode: str = "errorifexists", text_safe: bool = True) -> str:
    """Write ``df`` as CSV files; return the folder. Default folder: a fresh
    one under the shared checkpoint folder."""
    path = path or shared_dir(df.sparkSession, "csv")
    options = TEXT_SAFE if text_safe else {}
    df.write.mode(mode).option("header", str(header).lower()).options(**options).csv(path)
    return path

"""Learnable test set for the classifiers: ``documents`` joined with ``labels``.

Text statistics are computed with built-in string functions while the text is
still in the scan stage, so only the doc id and a few doubles reach the join
(the text is shuffled only where a few scan tasks hold most rows, ``spread``). Label = ``quality``. The split is the hash
split on ``doc_id``; the assembler and scaler are fitted on the training part
only, and the prepared rows are persisted because every model fit iterates
over them. Fits are kept in the shared folder (``sources/fits.py``), so another session
reads them. Before that the feature rows are checkpointed and re-partitioned
by row count: the text layout would leave many tiny partitions.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import features, models, split
from cohortlab.operators.broadcast import bounded_broadcast, fits_broadcast
from cohortlab.plans.catalog import table
from cohortlab.sources import fits
from cohortlab.sources.cache import ROWS_PER_PARTITION, rebalance

TEXT_FEATURES = ("n_chars", "n_words", "n_distinct", "type_token_ratio", "digit_share",
                 "upper_share", "punct_share", "mean_word_len")
SALT = split.SEED
#: A scan task with fewer rows stays as it is; rows of the table behind a task once they are dealt.
SPREAD_ROWS, SPREAD_MOST = 5_000, 50_000

_PREPARED: dict[tuple, DataFrame] = {}
_PIPELINES: dict[tuple, object] = {}
_FITTED: dict[tuple, object] = {}


def text_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per-document statistics of the whole text, JVM-side. Words are split once, in a
    projection of their own."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    # lower-casing neither makes nor takes white space
    words = F.when(F.length(F.trim(t)) > 0, F.split(F.lower(F.trim(t)), r"\s+"))
    d = docs.select("doc_id", t.alias("_t"), F.length(t).alias("_chars"), words.alias("_words"))
    none = F.col("_words").isNull()
    d = d.select("doc_id", "_t", "_chars", F.when(none, F.lit(0)).otherwise(F.size("_words")).alias("_n"),
                 F.when(none, F.lit(0)).otherwise(F.size(F.array_distinct("_words"))).alias("_distinct"))
    t, n_chars, n_words, n_distinct = (F.col(c) for c in ("_t", "_chars", "_n", "_distinct"))

    def share(pattern):
        return F.try_divide((n_chars - F.length(F.regexp_replace(t, pattern, ""))).cast("double"),
                            n_chars)

    cols = {
        "n_chars": n_chars.cast("double"),
        "n_words": n_words.cast("double"),
        "n_distinct": n_distinct.cast("double"),
        "type_token_ratio": F.try_divide(n_distinct.cast("double"), n_words),
        "digit_share": share(r"[0-9]"),
        "upper_share": share(r"\p{Lu}"),
        "punct_share": share(r"\p{P}"),
        "mean_word_len": F.try_divide(
            F.length(F.regexp_replace(t, r"\s+", "")).cast("double"), n_words),
    }
    return d.select("doc_id", *[F.coalesce(e, F.lit(0.0)).alias(n) for n, e in cols.items()])


def spread(docs: DataFrame, scan: DataFrame, fewest_rows: int = SPREAD_ROWS) -> DataFrame:
    """``docs`` dealt over all cores by doc_id where few tasks read most of ``scan``, its table:
    one task reads a row group, however large. Looks at the scan without its texts."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    r = (scan.select("doc_id").groupBy(F.spark_partition_id().alias("_part")).count()
         .agg(F.max("count").alias("most"), F.sum("count").alias("n")).first())
    most, n = r["most"] or 0, r["n"] or 0
    if most <= max(fewest_rows, 2 * n // cores, 1):
        return docs
    return docs.filter(F.col("doc_id").isNotNull()).repartition(max(2 * cores, -(-n // SPREAD_MOST)), "doc_id")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    scan = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    ids, docs = bounded_broadcast(lab.select("doc_id").distinct()), scan
    # only labelled documents reach the text work while their ids fit a broadcast;
    # beyond that the text work runs on all of them and the narrow rows are joined
    if fits_broadcast(ids, ids.count()):
        docs = docs.join(ids, "doc_id", "left_semi")
    return text_features(spread(docs.select("doc_id", "text"), scan)).join(lab, on="doc_id", how="inner")


def table_state(spark: SparkSession, sf: str, names) -> tuple:
    """The session, the folder and the state of some of its tables: what is kept
    for a table is made anew once the table is rewritten."""
    state = []
    for t in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        state += [fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()]
    return (spark.sparkContext.applicationId, sf, *state)


def _key(spark: SparkSession, sf: str) -> tuple:
    return table_state(spark, sf, ("documents", "labels"))


def _fit_state(spark: SparkSession, sf: str, *settings) -> tuple:
    """What a kept fit depends on: the tables, not the session."""
    return (*table_state(spark, sf, ("documents", "labels"))[1:], TEXT_FEATURES, SALT, *settings)


def _slot(sf: str, name: str) -> str:
    return f"{hashlib.sha256(sf.encode()).hexdigest()[:12]}/{name}"


def clear() -> None:
    """Release the prepared rows and forget the handles of the fits; the fits in the shared
    folder stay."""
    for df in _PREPARED.values():
        try:
            df.unpersist()
        except Exception:  # noqa: BLE001 - its session has ended
            pass
    for memo in (_PREPARED, _PIPELINES, _FITTED):
        memo.clear()


def prepared(spark: SparkSession, sf: str, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """doc_id, split, label, features, scaledFeatures (persisted until ``clear``)."""
    k = _key(spark, sf)
    if k not in _PREPARED:
        d = split.three_way_split(rebalance(labelled(spark, sf), rows_per_partition), ["doc_id"], salt=SALT)
        pm = fits.kept(spark, _slot(sf, "pipeline"), _fit_state(spark, sf),
                       lambda: features.fit_pipeline(d.filter(F.col("split") == "train"), TEXT_FEATURES),
                       lambda m, path: m.write().save(path), PipelineModel.load)
        _PIPELINES[k] = pm
        _PREPARED[k] = (pm.transform(d).select("doc_id", "split", "label", *TEXT_FEATURES, "scaledFeatures")
                        .persist(StorageLevel.MEMORY_AND_DISK))
    return _PREPARED[k]


def feature_model(spark: SparkSession, sf: str):
    """The assembler + scaler fitted on the training rows (for new rows or a stream)."""
    prepared(spark, sf)
    return _PIPELINES[_key(spark, sf)]


def fitted(spark: SparkSession, sf: str, name: str):
    k = (*_key(spark, sf), name)
    if k not in _FITTED:
        est = models.estimator(name)
        settings = est.settings if hasattr(est, "settings") else sorted(
            (p.name, v) for p, v in est.extractParamMap().items())
        _FITTED[k] = fits.kept(
            spark, _slot(sf, name), _fit_state(spark, sf, str(settings)),
            lambda: models.fit_models(prepared(spark, sf).filter(F.col("split") == "train"), [name])[name],
            models.save_model, lambda path: models.load_model(name, path))
    return _FITTED[k]

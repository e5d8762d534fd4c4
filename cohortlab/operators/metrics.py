"""Scoring and evaluation.

The reference counts each confusion cell with its own filter and action (seven
jobs per scored set) and reads AUROC through an evaluator that returns one
number per call. Here each metric is a DataFrame: all counts of all groups
(model x split) come out of one aggregate with ``count_if``, and the metrics
are expressions over those counts.

Definitions are the standard ones (the reference mislabels its cells, see
README): positive = 1; precision = tp / (tp + fp); recall = tp / (tp + fn).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import all_of, match_flag
from cohortlab.operators.ranges import exclusive_prefix
from cohortlab.sources.cache import cut_lineage


def prediction_match(df: DataFrame, pred_col: str = "prediction", label_col: str = "label",
                     keep: Sequence[str] = (), out: str = "equal") -> DataFrame:
    """``keep`` columns, prediction, label and a 0/1 ``equal`` flag."""
    return df.select(*keep, pred_col, label_col, match_flag(pred_col, label_col).alias(out))


def cast_label(df: DataFrame, label_col: str, to: str = "double") -> DataFrame:
    """Cast the label in place (P13), e.g. to double for the SVC evaluator."""
    return df.withColumn(label_col, F.col(label_col).cast(to))


def filter_chain(df: DataFrame, *conds: Column) -> DataFrame:
    """Rows meeting every condition (P15), as one filter."""
    return df.filter(all_of(list(conds)))


def row_count(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Row count per group (A5)."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, pred_col: str = "prediction", label_col: str = "label",
                     group_cols: Sequence[str] = (), positive: float = 1.0) -> DataFrame:
    """n, correct, wrong and the four cells per group, one aggregate.

    A row with a null prediction or label counts in ``n`` and ``wrong`` only.
    """
    p, y = F.col(pred_col), F.col(label_col)
    pos = F.lit(positive)
    eq = p == y
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(eq).alias("correct"),
        F.count_if(~F.coalesce(eq, F.lit(False))).alias("wrong"),
        F.count_if((p == pos) & (y == pos)).alias("tp"),
        F.count_if((p != pos) & (y != pos)).alias("tn"),
        F.count_if((p == pos) & (y != pos)).alias("fp"),
        F.count_if((p != pos) & (y == pos)).alias("fn"),
    )


def precision_recall(cm: DataFrame) -> DataFrame:
    """Standard precision, recall and accuracy over ``confusion_matrix`` (A7);
    null where a denominator is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cm.select(
        "*",
        F.try_divide(tp.cast("double"), tp + fp).alias("precision"),
        F.try_divide(tp.cast("double"), tp + fn).alias("recall"),
        F.try_divide(F.col("correct").cast("double"), F.col("n")).alias("accuracy"),
    )


def _hard_auc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tpr = F.try_divide(tp.cast("double"), tp + fn)
    tnr = F.try_divide(tn.cast("double"), tn + fp)
    return (tpr + tnr) / F.lit(2.0)


def auroc_hard(df: DataFrame, pred_col: str = "prediction", label_col: str = "label",
               group_cols: Sequence[str] = (), positive: float = 1.0) -> DataFrame:
    """Area under ROC when the score is the 0/1 prediction.

    With one threshold the ROC curve has one inner point, so the area is
    (TPR + TNR) / 2 (balanced accuracy) — what the reference's evaluator
    returns for hard predictions. Null when a group holds one class only.
    """
    cm = confusion_matrix(df, pred_col, label_col, group_cols, positive)
    return cm.select(*group_cols, _hard_auc(F.col("tp"), F.col("tn"), F.col("fp"),
                                            F.col("fn")).alias("auroc"))


def score_counts(df: DataFrame, score_col: str, label_col: str, group_cols: Sequence[str] = (),
                 positive: float = 1.0) -> DataFrame:
    """Positive (``_p``) and other (``_n``) rows per group and distinct score."""
    y = F.col(label_col)
    return (df.filter(F.col(score_col).isNotNull() & y.isNotNull())
            .groupBy(*group_cols, score_col)
            .agg(F.count_if(y == F.lit(positive)).alias("_p"),
                 F.count_if(y != F.lit(positive)).alias("_n")))


def auroc_exact(df: DataFrame, score_col: str, label_col: str = "label",
                group_cols: Sequence[str] = (), positive: float = 1.0,
                ranges: int | None = None, materialize: bool = True) -> DataFrame:
    """Exact area under ROC from (score, label) pairs (A9), ties counted half.

    AUC = sum over scores s of pos(s) * (neg(< s) + neg(s) / 2) / (P * N).
    Rows collapse to one row per (group, distinct score) first (partial
    aggregation, so a hot score costs nothing), then the running count of
    negatives is an exact distributed prefix sum. Null for a one-class group.
    ``materialize`` checkpoints the per-score table once (the range bounds,
    the offsets and the final sum all read it), so an expensive score column
    (a model transform) is computed once.
    """
    g = score_counts(df, score_col, label_col, group_cols, positive)
    if materialize and not df.isStreaming:
        g = cut_lineage(g)
    return auroc_from_counts(g, score_col, group_cols, ranges)


def auroc_from_counts(counts: DataFrame, score_col: str, group_cols: Sequence[str] = (),
                      ranges: int | None = None) -> DataFrame:
    """A9 from a table of ``score_counts``: one row per (group, score) with its positives
    and negatives, whether counted in one pass or kept up by a stream."""
    g = exclusive_prefix(counts, [score_col], "_n", "_neg_before", group_cols, ranges)
    return (g.groupBy(*group_cols)
            .agg(F.sum(F.col("_p") * (F.col("_neg_before") + F.col("_n") / F.lit(2.0)))
                 .alias("_num"),
                 F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
            .select(*group_cols,
                    F.try_divide(F.col("_num"), F.col("_P").cast("double") * F.col("_N"))
                    .alias("auroc")))


def leaderboard(scored: DataFrame, model_col: str = "model", pred_col: str = "prediction",
                label_col: str = "label", split_col: str | None = "split",
                split: str = "test", order: Sequence[str] | None = None) -> DataFrame:
    """One row per model on one split: auroc (hard), accuracy, rank (A10).

    ``rank`` orders by auroc (ties by name). ``order`` adds ``pos``, the
    model's place in a fixed list (the reference lists its five scores in a
    fixed order). The rank window runs over the aggregated table (one row per
    model).
    """
    d = scored if split_col is None else scored.filter(F.col(split_col) == F.lit(split))
    cm = precision_recall(confusion_matrix(d, pred_col, label_col, [model_col]))
    board = cm.select(model_col,
                      _hard_auc(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")).alias("auroc"),
                      "accuracy")
    w = Window.orderBy(F.desc_nulls_last("auroc"), F.col(model_col))
    board = board.withColumn("rank", F.row_number().over(w))
    if order is not None:
        board = board.withColumn(
            "pos", F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model_col))
            .cast("int"))
    return board

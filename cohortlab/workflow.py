"""The reference notebook's whole flow as one call over any labelled table.

``notebook_flow`` composes the library's operators in the notebook's order and
returns every table the notebook shows or draws from, as lazy or persisted
DataFrames. Nothing is collected except fitted-model state (kept by MLlib on
the driver) and the measured small sides of broadcasts.

The corrections listed in the README apply: standard metric definitions, a
hash split on the id, scaler and PCA fitted after the split on training rows,
and every model evaluated on its own predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators import features, metrics, models, profile, split
from cohortlab.operators.profile import RADAR_ORDER
from cohortlab.sources.cache import persist_parts, unpersist_parts


def notebook_flow(df: DataFrame, id_col: str = "id", label_col: str = "diagnosis",
                  positive="M", negative="B", label_out: str = "label",
                  record_ids: dict | None = None, families: Sequence[str] = ("worst", "mean"),
                  measures: Sequence[str] = RADAR_ORDER, model_names: Sequence[str] =
                  models.MODEL_NAMES, salt: str = split.SEED, pca_k: int = 2,
                  handle_invalid: str = "error", feature_cols: Sequence[str] | None = None) -> dict:
    """Run the flow; return a dict of DataFrames (and the fitted models).

    ``record_ids`` maps a class value to the id of the record to profile
    (default: the lowest id of each class). ``families`` x ``measures`` name
    the radar attributes as ``<measure>_<family>``; missing ones are skipped.
    Features are ``feature_cols``, by default every column other than the id and
    the labels (P9), so a column that is no number fails the assembler. A null
    feature fails the assembler as in the reference (``handle_invalid="error"``);
    ``"skip"`` leaves such rows out of training and scoring, ``"keep"`` makes
    them NaN. The prepared rows and the scores are persisted (every fit and four
    metrics read them): pass the result to ``release`` when done.
    """
    out: dict = {}
    out["summary"] = profile.describe_table(profile.drop_null_heavy_rows(df))
    enc = profile.encode_label(df, label_col, positive, out=label_out)
    out["encoded"] = enc
    feats = list(feature_cols) if feature_cols is not None else profile.feature_columns(
        enc, [id_col, label_col, label_out])

    fam = {f: [f"{m}_{f}" for m in measures if f"{m}_{f}" in enc.columns] for f in families}
    fam = {f: a for f, a in fam.items() if a}
    attrs = [a for a_list in fam.values() for a in a_list] or feats
    stats = profile.class_stats(enc, label_col, attrs)
    out["class_stats"] = stats
    if record_ids:
        key_schema = f"`{label_col}` string, `{id_col}` {dict(enc.dtypes)[id_col]}"
        keys = df.sparkSession.createDataFrame([(str(c), i) for c, i in record_ids.items()],
                                               key_schema)
    else:
        keys = enc.groupBy(label_col).agg(F.min(id_col).alias(id_col))
    records = profile.record_profile(enc, id_col, label_col, attrs, keys, stats=stats)
    baseline = profile.baseline_profile(stats, label_col)
    out["record_profile"] = records
    out["baseline_profile"] = baseline
    if fam:
        out["radar"] = profile.radar_table(baseline, records, label_col, fam, negative,
                                           [negative, positive])

    parts = split.three_way_split(enc, [id_col], salt=salt)
    train_rows = parts.filter(F.col("split") == "train")
    pm = features.fit_pipeline(train_rows, feats, features_col="features",
                               handle_invalid=handle_invalid)
    [prepared] = persist_parts(pm.transform(parts).select(id_col, "split", label_out, "scaledFeatures"))
    train = prepared.filter(F.col("split") == "train")
    out["prepared"] = prepared
    pca = features.fit_pca(train, pca_k)
    out["pca_table"] = features.pca_table(train, pca, keep=[label_out])
    out["pca_explained"] = features.pca_explained(pca, df.sparkSession)

    fitted = models.fit_models(train, model_names, label_col=label_out)
    out["models"] = fitted
    # four metrics read the scores: score every row with every model once
    [scored] = persist_parts(models.score_splits(fitted, prepared, [id_col], label_col=label_out))
    out["scored"] = scored
    out["leaderboard"] = metrics.leaderboard(scored, order=model_names)
    out["metrics"] = metrics.precision_recall(
        metrics.confusion_matrix(scored, group_cols=["model", "split"]))
    out["auroc_hard"] = metrics.auroc_hard(scored, group_cols=["model", "split"])
    out["auroc_exact"] = metrics.auroc_exact(scored, "score", group_cols=["model", "split"])
    return out


def release(out: dict) -> None:
    """Unpersist what ``notebook_flow`` kept."""
    unpersist_parts(out["scored"], out["prepared"])

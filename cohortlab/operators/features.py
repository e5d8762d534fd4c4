"""Feature preparation.

Stock ``pyspark.ml`` stages: fitting runs as distributed summary jobs
(column statistics, covariance), only the fitted state (d numbers, or a d x k
matrix for PCA) lives on the driver. Fit on the training part only; the
reference fits the scaler and PCA before its second split, which lets
validation rows leak into the scaling (README, Q10).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array as _vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PCA_WIDTH = 65_535


def vector_to_array(c: str | Column) -> Column:
    """ML vector -> array<double> (F6), JVM-side."""
    return _vector_to_array(F.col(c) if isinstance(c, str) else c, "float64")


def array_to_columns(df: DataFrame, array_col: str, names: Sequence[str],
                     keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus one column per array item."""
    a = F.col(array_col)
    return df.select(*keep, *[a.getItem(i).alias(n) for i, n in enumerate(names)])


def vector_to_columns(df: DataFrame, vector_col: str, names: Sequence[str],
                      keep: Sequence[str] = ()) -> DataFrame:
    """F6 + P14 in one projection."""
    arr = vector_to_array(vector_col)
    return df.select(*keep, *[arr.getItem(i).alias(n) for i, n in enumerate(names)])


def assembler(input_cols: Sequence[str], output_col: str = "features",
              handle_invalid: str = "error") -> VectorAssembler:
    """VectorAssembler (M1); ``handle_invalid`` is ``error``, ``skip`` or ``keep``."""
    return VectorAssembler(inputCols=list(input_cols), outputCol=output_col,
                           handleInvalid=handle_invalid)


def assemble(df: DataFrame, input_cols: Sequence[str] | None = None,
             output_col: str = "features", handle_invalid: str = "error",
             exclude: Sequence[str] = ()) -> DataFrame:
    """Assemble ``input_cols``; by default every column not in ``exclude``, in
    table order (P9: the feature list is the set difference of the names)."""
    if input_cols is None:
        input_cols = [c for c in df.columns if c not in set(exclude)]
    return assembler(input_cols, output_col, handle_invalid).transform(df)


def scaler(input_col: str = "features", output_col: str = "scaledFeatures",
           with_mean: bool = False, with_std: bool = True) -> StandardScaler:
    """StandardScaler (M3): x / sample stddev by default; a constant column gives 0."""
    return StandardScaler(inputCol=input_col, outputCol=output_col,
                          withMean=with_mean, withStd=with_std)


def fit_standard_scaler(train: DataFrame, input_col: str = "features",
                        output_col: str = "scaledFeatures") -> StandardScalerModel:
    return scaler(input_col, output_col).fit(train)


def feature_pipeline(input_cols: Sequence[str], features_col: str = "features",
                     scaled_col: str = "scaledFeatures", handle_invalid: str = "error",
                     pca_k: int | None = None, pca_col: str = "pcaFeatures") -> Pipeline:
    """Assembler + scaler (+ optional PCA) as one pipeline (M2)."""
    stages = [assembler(input_cols, features_col, handle_invalid),
              scaler(features_col, scaled_col)]
    if pca_k:
        check_pca_width(len(input_cols))
        stages.append(PCA(k=pca_k, inputCol=scaled_col, outputCol=pca_col))
    return Pipeline(stages=stages)


def fit_pipeline(train: DataFrame, input_cols: Sequence[str], **kw) -> PipelineModel:
    return feature_pipeline(input_cols, **kw).fit(train)


def check_pca_width(d: int) -> None:
    if d > MAX_PCA_WIDTH:
        raise ValueError(f"PCA over {d} columns: the d x d covariance is built on the driver; "
                         f"at most {MAX_PCA_WIDTH} columns")


def vector_width(df: DataFrame, col: str) -> int:
    """Vector size from the column's ML metadata, else from one row."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    if "attrs" in meta:
        return sum(len(v) for v in meta["attrs"].values())
    first = df.select(col).first()
    return len(first[0]) if first is not None and first[0] is not None else 0


def fit_pca(train: DataFrame, k: int = 2, input_col: str = "scaledFeatures",
            output_col: str = "pcaFeatures") -> PCAModel:
    """PCA (M4). Spark centres the covariance but projects x (not x - mean)."""
    check_pca_width(vector_width(train, input_col))
    return PCA(k=k, inputCol=input_col, outputCol=output_col).fit(train)


def pca_signs(model: PCAModel, eps: float = 1e-6) -> list[float]:
    """+1/-1 per component so that its first loading (in feature order) with
    magnitude over ``eps`` is positive: makes the arbitrary eigenvector sign
    reproducible. (The largest loading would tie for two scaled columns.)"""
    pc = model.pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        s = 1.0
        for v in pc[:, j]:
            if abs(v) > eps:
                s = 1.0 if v > 0 else -1.0
                break
        signs.append(s)
    return signs


def pca_table(df: DataFrame, model: PCAModel, names: Sequence[str] | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """PCA output as columns ``PCA_1``.. beside ``keep`` (M5), sign-fixed.

    The projection and the kept columns come from the same rows in one
    projection, so no row index or join is needed (the reference numbers both
    sides and joins them)."""
    signs = pca_signs(model)
    names = list(names) if names else [f"PCA_{i + 1}" for i in range(len(signs))]
    out = model.transform(df)
    arr = vector_to_array(model.getOutputCol())
    return out.select(*keep, *[(arr.getItem(i) * F.lit(s)).alias(n)
                               for i, (n, s) in enumerate(zip(names, signs))])


def pca_explained(model: PCAModel, spark=None) -> DataFrame:
    """Explained-variance ratio per component (M6), from the fitted model."""
    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
    ev = [float(v) for v in model.explainedVariance.toArray()]
    rows, acc = [], 0.0
    for i, v in enumerate(ev):
        acc += v
        rows.append((i + 1, v, acc))
    return spark.createDataFrame(rows, "component int, explained_variance double, cumulative double")

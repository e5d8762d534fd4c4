"""cohortlab — labelled-table analytics on Spark DataFrames.

    from cohortlab import profile, split, features, models, metrics
    stats = profile.class_stats(df, "diagnosis", feature_cols)

Modules: ``profile`` (null checks, encoding, lookups, per-class statistics and
profiles), ``align`` (row index, positional join), ``split`` (hash splits),
``features`` (assembler, scaler, PCA), ``models`` (five classifiers, scoring),
``metrics`` (confusion counts, precision/recall, AUROC, leaderboard),
``sources`` (CSV, views, persistence), ``streaming``, ``functions``.
"""

from cohortlab.operators import align, features, metrics, models, profile, split

__version__ = "0.1.0"

__all__ = ["align", "features", "metrics", "models", "profile", "split"]

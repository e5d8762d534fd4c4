"""A table with the reference's shape (FIXTURES F-A), numbers from a fixed rule.

357 benign + 212 malignant rows, ``id int``, ``diagnosis`` M/B and 30 double
features (10 measures x mean/se/worst). Values are md5 of (feature, id) scaled
to [1, 2), with the malignant class shifted up on five measures so that the
classes are separable. Built with Spark expressions from ``spark.range``.
"""

from pyspark.sql import functions as F

# The ten measures and three families of the reference's table,
# in its column order.
MEASURES = ("radius", "texture", "perimeter", "area", "smoothness", "compactness",
            "concavity", "concave_points", "symmetry", "fractal_dimension")
FAMILIES = ("mean", "se", "worst")
SHIFTED = ("radius", "perimeter", "area", "concavity", "concave_points")

FEATURES = tuple(f"{m}_{f}" for f in FAMILIES for m in MEASURES)


def cancer_like(spark, n_benign: int = 357, n_malignant: int = 212):
    base = spark.range(n_benign + n_malignant).select(
        (F.lit(84_000_000) + F.col("id") * F.lit(7919)).cast("int").alias("id"),
        F.when(F.col("id") < F.lit(n_malignant), F.lit("M"))
        .otherwise(F.lit("B")).alias("diagnosis"))
    cols = [F.col("id"), F.col("diagnosis")]
    for f in FAMILIES:
        for m in MEASURES:
            name = f"{m}_{f}"
            u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(name), F.col("id"))), 1, 8),
                        16, 10).cast("double") / F.lit(4294967296.0))
            shift = F.when((F.col("diagnosis") == "M") & F.lit(m in SHIFTED), F.lit(0.6)) \
                .otherwise(F.lit(0.0))
            cols.append((F.lit(1.0) + u + shift).alias(name))
    return base.select(*cols)

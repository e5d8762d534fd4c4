"""Audit of fitted decision trees (C2): rows routed through the tree by Spark.

``splits_of`` reads a fitted Spark tree into plain nodes (a tree is bounded by its depth,
not by the data). ``audit`` sends every row down the tree once, counts classes per leaf in
one aggregate and adds them up towards the root, so each node's rows, class shares and Gini
gain come from the data and not from what the fit stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.features import vector_to_array


@dataclass
class TreeSplit:
    feature: int
    cut: float


def splits_of(tree) -> dict[int, TreeSplit]:
    """path -> split of a fitted Spark tree on continuous features; 1 is the root."""
    out, todo = {}, [(1, tree._call_java("rootNode"))]
    while todo:
        path, node = todo.pop()
        if node.getClass().getSimpleName() != "InternalNode":
            continue
        out[path] = TreeSplit(node.split().featureIndex(), node.split().threshold())
        todo += [(2 * path, node.leftChild()), (2 * path + 1, node.rightChild())]
    return out


def _route(splits: dict[int, TreeSplit], path: int = 1) -> str:
    if path not in splits:
        return str(path)
    s = splits[path]
    return (f"CASE WHEN _x[{s.feature}] <= {s.cut!r}D THEN {_route(splits, 2 * path)} "
            f"ELSE {_route(splits, 2 * path + 1)} END")


def gini(n: float, pos: float) -> float:
    return 1.0 - (pos / n) ** 2 - ((n - pos) / n) ** 2 if n else 0.0


def audit(rows: DataFrame, tree, features_col: str, label_col: str) -> DataFrame:
    """``path, feature, cut, n, n_positive, gain`` of each node of a tree for a 0/1 label;
    ``feature`` is -1 and ``cut`` null in a leaf. Rows without a label are left out."""
    splits = splits_of(tree)
    counts = (rows.filter(F.col(label_col).isNotNull())
              .select(vector_to_array(features_col).alias("_x"), F.col(label_col).cast("long").alias("_y"))
              .select(F.expr(_route(splits)).cast("long").alias("path"), "_y")
              .groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).collect())   # one row a leaf
    total = {p: (0, 0) for s in splits for p in (s, 2 * s, 2 * s + 1)} | {1: (0, 0)}
    for r in counts:
        p = r["path"]
        while p:
            total[p] = (total[p][0] + r["n"], total[p][1] + r["pos"])
            p //= 2
    out = []
    for p, (n, pos) in sorted(total.items()):
        s, gain = splits.get(p), 0.0
        if s and n:
            (nl, pl), (nr, pr) = total[2 * p], total[2 * p + 1]
            gain = gini(n, pos) - nl / n * gini(nl, pl) - nr / n * gini(nr, pr)
        out.append((p, s.feature if s else -1, s.cut if s else None, n, pos, gain))
    return rows.sparkSession.createDataFrame(
        out, "path bigint, feature int, cut double, n bigint, n_positive bigint, gain double")

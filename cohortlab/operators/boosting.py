"""Second-order gradient boosting of trees on binned features.

``BoostedTreesClassifier`` fits additive trees to a binary label by Newton steps on the
logistic loss. With gradient ``g = p - y`` and hessian ``h = p (1 - p)`` summed to G and H,
a split gains ``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2) - 2 gamma`` and a leaf adds
``-step * G / (H + l2)`` to the margin. Trees grow best leaf first up to ``leaves``, or level
by level up to ``depth``.

How it runs on Spark:

*   Features are cut into at most ``bins`` bins once: at the middles between their values
    where they have few, else at quantiles of Spark's sketch. Rows become blocks of binned
    features, labels and margins, dealt over the cluster and persisted (memory, then disk).
*   A round of splitting is one pass over the blocks that adds up histograms per (leaf,
    feature, bin) in every task; those of a feature meet in one task, which adds them up
    and looks for each leaf's best split by the features it has (all of them while a pass's
    histograms stay below ``ADDED_BYTES``). A pass covers the children of
    every leaf that may be split next, so a tree takes about as many passes as it is deep,
    and still splits best leaf first. This is the one place of the library outside ``llm``
    that works on an RDD: a task adds to one array for all its rows, which rows of (leaf,
    feature, bin) through a shuffle took ten times as long.
*   No row and no histogram reaches the driver: it gets one split and one sum per leaf from
    each task that adds up histograms, whatever the rows, features and bins. Above
    ``HISTOGRAM_BYTES`` a task takes the features block by block.
*   A task has at least ``FEWEST_CELLS`` of rows times features, as a pass has a fixed price a
    task, in seconds and in results. Fewer rows lie in one partition; its task then runs all
    rounds by the same functions, without a job for each. It keeps the histograms, so only
    the smaller child of a leaf is added up; its sibling is the parent's less that.
*   Margins are kept with the blocks; every ``CUT_ROUNDS`` rounds the blocks are written
    as a reliable checkpoint, so a lost executor repeats a few rounds at most.

Rows with a null label are left out. A feature that is NaN goes to the last bin, as does
everything above its last cut. A label of one class gives the base margin alone.
"""

from __future__ import annotations

import json
import math
import operator
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.features import vector_to_array
from cohortlab.sources import cache

HISTOGRAM_BYTES = 256 * 1024 * 1024
#: Histograms of a pass, from all its tasks, that one task adds up and judges.
ADDED_BYTES = 32 * 1024 * 1024
#: Rows times features of a task. A pass over 200,000 rows of 8 features takes a task some 0.05 s,
#: the two stages of a pass more than 0.1 s whatever they hold.
FEWEST_CELLS = 1_600_000
CUT_ROUNDS = 25


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    step: float = 0.1
    leaves: int | None = 31
    depth: int | None = None
    l2: float = 0.0
    gamma: float = 0.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    from_mean: bool = True
    bins: int = 255


@dataclass
class Node:
    """A node of a tree; ``feature`` is -1 in a leaf, rows below ``cut`` go left."""

    g: float
    h: float
    n: int
    depth: int = 0
    feature: int = -1
    bin: int = -1
    cut: float = math.nan
    gain: float = 0.0
    left: int = -1
    right: int = -1
    value: float = 0.0


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    left: tuple[float, float, int]
    right: tuple[float, float, int]


def best_split(hist: np.ndarray, s: Settings, first_feature: int = 0) -> Split | None:
    """The split of highest gain of a histogram (feature, bin, (G, H, n)); at a tie the
    first feature and the lowest cut."""
    total = hist[0].sum(axis=0)
    left = np.cumsum(hist, axis=1)[:, :-1]
    right = total - left
    gl, hl, nl = np.moveaxis(left, 2, 0)
    gr, hr, nr = np.moveaxis(right, 2, 0)
    ok = ((nl >= s.min_rows) & (nr >= s.min_rows) & (nl > 0) & (nr > 0)
          & (hl >= s.min_hessian) & (hr >= s.min_hessian))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + s.l2) + gr * gr / (hr + s.l2) - total[0] * total[0] / (total[1] + s.l2) - 2 * s.gamma
    gain = np.where(ok & ~np.isnan(gain), gain, -np.inf)
    if not gain.size or not gain.max() > 0:
        return None
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    a, z = left[f, b], right[f, b]
    return Split(float(gain[f, b]), first_feature + int(f), int(b),
                 (float(a[0]), float(a[1]), int(a[2])), (float(z[0]), float(z[1]), int(z[2])))


@dataclass
class Block:
    """Rows of a partition: bins by feature, labels and margins."""

    bins: np.ndarray
    y: np.ndarray
    margin: np.ndarray

    def places(self, nodes: list[Node]) -> np.ndarray:
        """The leaf of each row in a tree whose children stand behind their parents."""
        at = np.zeros(len(self.y), dtype=np.int32)
        for k, n in enumerate(nodes):
            if n.feature >= 0:
                here = np.flatnonzero(at == k)
                at[here] = np.where(self.bins[n.feature, here] <= n.bin, n.left, n.right)
        return at

    def grown(self, nodes: list[Node]) -> Block:
        """The block after a tree."""
        value = np.array([n.value for n in nodes])
        return Block(self.bins, self.y, self.margin + value[self.places(nodes)])

    def histogram(self, nodes: list[Node], wanted: list[int], features: range, size: int) -> np.ndarray:
        """Sums (wanted leaf, feature, bin) of gradient, hessian and rows."""
        slot = np.full(len(nodes), -1)
        slot[wanted] = np.arange(len(wanted))
        slot = slot[self.places(nodes)]
        rows = np.flatnonzero(slot >= 0)
        p = 1.0 / (1.0 + np.exp(-self.margin[rows]))
        g, h, slot = p - self.y[rows], p * (1.0 - p), slot[rows] * size
        out = np.empty((len(wanted), len(features), size, 3))
        for i, f in enumerate(features):
            cell = slot + self.bins[f, rows]
            for j, w in enumerate((g, h, None)):
                out[:, i, :, j] = np.bincount(cell, w, minlength=len(wanted) * size).reshape(len(wanted), size)
        return out


def _blocks(batches: Iterator[pd.DataFrame], dim: int, base: float) -> Iterator[Block]:
    for pdf in batches:
        if len(pdf):
            yield Block(np.ascontiguousarray(pdf[[f"_b{i}" for i in range(dim)]].to_numpy(np.uint16).T),
                        pdf["_y"].to_numpy(float), np.full(len(pdf), base))


#: Sums (G, H, n) of a leaf and its best split.
Judged = tuple[tuple[float, float, int], Split | None]


def _better(a: Judged | None, b: Judged) -> Judged:
    """Of one leaf over two blocks of features; at a tie the first."""
    if a is None or b[1] is None or (a[1] is not None and a[1].gain >= b[1].gain):
        return a or b
    return a[0], b[1]


def _judge(hist: np.ndarray, s: Settings, first_feature: int) -> Judged:
    g, h, n = hist[0].sum(axis=0)
    return (float(g), float(h), int(n)), best_split(hist, s, first_feature)


class _Histograms:
    """Splits of leaves by the histograms of one round's blocks, by blocks of features."""

    def __init__(self, sizes: Sequence[int], s: Settings):
        self.sizes, self.s = sizes, s
        leaf_bytes = 24 * max(sizes) * len(sizes)
        most = s.leaves or 2 ** min(s.depth or 6, 20)
        self.keep = leaf_bytes * 2 * most <= HISTOGRAM_BYTES
        self.block = len(sizes) if self.keep else max(1, HISTOGRAM_BYTES // (48 * max(sizes) * most))

    def features(self) -> Iterator[range]:
        for a in range(0, len(self.sizes), self.block):
            yield range(a, min(a + self.block, len(self.sizes)))

    def add(self, blocks: Iterator[Block], nodes: list[Node], wanted: list[int], fs: range) -> np.ndarray:
        """Sums (wanted leaf, feature, bin, (G, H, n)) over blocks."""
        size = max(self.sizes[f] for f in fs)
        total = np.zeros((len(wanted), len(fs), size, 3))
        for b in blocks:
            total += b.histogram(nodes, wanted, fs, size)
        return total


class _InATask(_Histograms):
    """All rows are at hand. Histograms are kept while they are small, for their children."""

    def __init__(self, blocks: list[Block], sizes: Sequence[int], s: Settings):
        super().__init__(sizes, s)
        self.blocks, self.kept = blocks, {}

    def judge(self, nodes: list[Node], wanted: list[int], siblings: dict[int, tuple[int, int]]) -> dict[int, Judged]:
        """Of each leaf of ``wanted``, and of ``siblings`` (leaf -> its sibling, their parent)
        by subtraction."""
        best: dict[int, Judged] = {}
        parents = {k: self.kept.pop(parent) for k, (_, parent) in siblings.items()}
        for fs in self.features():
            hist = dict(zip(wanted, self.add(iter(self.blocks), nodes, wanted, fs)))
            for k, (small, _) in siblings.items():
                hist[k] = parents[k] - hist[small]
            for k, h in hist.items():
                best[k] = _better(best.get(k), _judge(h, self.s, fs[0]))
            if self.keep:
                self.kept.update(hist)
        return best


class _OverTasks(_Histograms):
    """The rows lie in many tasks; a feature's histograms are added up and judged in one."""

    def __init__(self, blocks: RDD, sizes: Sequence[int], s: Settings):
        super().__init__(sizes, s)
        self.blocks, self.keep = blocks, False

    def judge(self, nodes: list[Node], wanted: list[int], siblings: dict[int, tuple[int, int]]) -> dict[int, Judged]:
        best: dict[int, Judged] = {}
        plain, s = _Histograms(self.sizes, self.s), self.s          # goes to the tasks, without the RDD
        for fs in self.features():
            def added(blocks: Iterator[Block], fs=fs) -> Iterator[tuple[int, np.ndarray]]:
                total = plain.add(blocks, nodes, wanted, fs)
                yield from ((f, total[:, i, :plain.sizes[f]]) for i, f in enumerate(fs))

            # neighbouring features share a task, so the results come in order of features
            held = 24 * max(self.sizes[f] for f in fs) * len(fs) * len(wanted) * self.blocks.getNumPartitions()
            parts = min(len(fs), self.blocks.getNumPartitions(), -(-held // ADDED_BYTES))

            def judged(hists: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[Judged]]:
                of = sorted(((f, [_judge(h[None], s, f) for h in leaves]) for f, leaves in hists), key=lambda x: x[0])
                if of:
                    yield [reduce(_better, leaf) for leaf in zip(*(leaves for _, leaves in of), strict=True)]
            got = (self.blocks.mapPartitions(added)
                   .reduceByKey(operator.add, parts, lambda f, fs=fs, parts=parts: (f - fs[0]) * parts // len(fs))
                   .mapPartitions(judged).collect())
            for leaves in got:
                for k, j in zip(wanted, leaves, strict=True):
                    best[k] = _better(best.get(k), j)
        return best


def _case(nodes: list[Node], at: int = 0) -> str:
    """SQL of a tree over the feature array ``_x``."""
    n = nodes[at]
    if n.feature < 0:
        return f"{n.value!r}D"
    return f"CASE WHEN _x[{n.feature}] < {n.cut!r}D THEN {_case(nodes, n.left)} ELSE {_case(nodes, n.right)} END"


def grow(work: _InATask | _OverTasks, cuts: list[list[float]], s: Settings) -> list[Node]:
    """One tree over the blocks that ``work`` reaches."""
    total, first = work.judge([Node(0.0, 0.0, 0)], [0], {})[0]
    nodes = [Node(*total)]
    split: dict[int, Split | None] = {0: first}
    ahead: dict[int, tuple[int, int]] = {}                # leaf -> its children, made before it is split
    limit = s.leaves or 1 << 30
    active = {0}                                          # leaves of the tree as it stands
    while len(active) < limit:
        open_ = sorted((k for k in active if split[k] is not None and (s.depth is None or nodes[k].depth < s.depth)),
                       key=lambda k: (-split[k].gain, k))
        if not open_:
            break
        # without a bound on the leaves all of them are split, in whatever order
        best = open_[0] if s.leaves else next((k for k in open_ if k in ahead), open_[0])
        if best not in ahead:
            _look_ahead(work, nodes, split, ahead, [k for k in open_ if k not in ahead][:limit - len(active)])
        n, sp = nodes[best], split[best]
        n.left, n.right = ahead.pop(best)
        n.feature, n.bin, n.gain, n.cut = sp.feature, sp.bin, sp.gain, cuts[sp.feature][sp.bin]
        active = active - {best} | {n.left, n.right}
    return _compact(nodes, s)


def _look_ahead(work: _InATask | _OverTasks, nodes: list[Node], split: dict, ahead: dict,
                leaves: list[int]) -> None:
    """Splits of the children of ``leaves`` by one aggregate."""
    trial = [Node(**vars(n)) for n in nodes]
    wanted, siblings = set(), {}
    for k in leaves:
        sp = split[k]
        ahead[k] = (len(nodes), len(nodes) + 1)
        for g, h, n in (sp.left, sp.right):
            nodes.append(Node(g, h, n, nodes[k].depth + 1))
            trial.append(Node(g, h, n))
        trial[k].feature, trial[k].bin, (trial[k].left, trial[k].right) = sp.feature, sp.bin, ahead[k]
        small, large = sorted(ahead[k], key=lambda c: nodes[c].n)
        wanted.add(small)
        if work.keep:
            siblings[large] = (small, k)
        else:
            wanted.add(large)
    split.update((k, sp) for k, (_, sp) in work.judge(trial, sorted(wanted), siblings).items())


def _compact(nodes: list[Node], s: Settings) -> list[Node]:
    """The nodes that the tree reaches, in order of level and place, with leaf values."""
    order = [0]
    for k in order:
        if nodes[k].feature >= 0:
            order += [nodes[k].left, nodes[k].right]
    number = {k: i for i, k in enumerate(order)}
    out = []
    for k in order:
        n = Node(**vars(nodes[k]))
        n.left, n.right = number.get(n.left, -1) if n.feature >= 0 else -1, number.get(n.right, -1) if n.feature >= 0 else -1
        if n.feature < 0 and n.h + s.l2 > 0:
            n.value = -s.step * n.g / (n.h + s.l2)
        out.append(n)
    return out


def cut_points(df: DataFrame, cols: Sequence[str], bins: int) -> list[list[float]]:
    """Cuts of each column: middles of its values if it has at most ``bins``, else quantiles."""
    probs = [i / bins for i in range(1, bins)]
    got = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.percentile_approx(c, probs, 40 * bins).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(cols)) if (got[f"n{i}"] or 0) <= 1.1 * bins]
    values: dict[int, list[float]] = {}
    if few:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(cols[i]).cast("double").alias("v")) for i in few])
        # at most about 1.2 * bins values a column
        for r in df.select(F.inline(cells)).filter(F.col("v").isNotNull() & ~F.isnan("v")).distinct().collect():
            values.setdefault(r["i"], []).append(r["v"])
    out = []
    for i in range(len(cols)):
        v = sorted(values.get(i, []))
        if v and len(v) <= bins:
            out.append([(a + b) / 2 for a, b in zip(v, v[1:])])
        else:
            out.append(sorted({x for x in got[f"q{i}"] or [] if not math.isnan(x)}))
    return out


def rebalance(binned: DataFrame) -> DataFrame:
    """Binned rows (label, then the features) in tasks of no fewer than ``FEWEST_CELLS``."""
    return cache.rebalance(binned, fewest_rows=max(cache.FEWEST_ROWS, FEWEST_CELLS // (len(binned.columns) - 1)))


def _packed(binned: DataFrame, dim: int, base: float) -> RDD:
    """The rows as an RDD of blocks."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (pd.DataFrame({"block": [pickle.dumps(b)]}) for b in _blocks(batches, dim, base))
    return binned.mapInPandas(rows, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def _fit_over_tasks(blocks: RDD, cuts: list[list[float]], s: Settings) -> list[list[Node]]:
    trees: list[list[Node]] = []
    blocks, before = blocks.persist(StorageLevel.MEMORY_AND_DISK), None
    for t in range(s.rounds):
        # the first pass of a tree makes the blocks with the margins of the one before
        tree = grow(_OverTasks(blocks, [len(c) + 1 for c in cuts], s), cuts, s)
        if before is not None:
            before.unpersist()
        if tree[0].feature < 0:                           # nothing left to split
            break
        trees.append(tree)
        before, blocks = blocks, blocks.map(lambda b, tree=tree: b.grown(tree)).persist(StorageLevel.MEMORY_AND_DISK)
        if t % CUT_ROUNDS == CUT_ROUNDS - 1:
            blocks.checkpoint()
    if before is not None:
        before.unpersist()
    blocks.unpersist()
    return trees


def _fit_in_a_task(blocks: RDD, cuts: list[list[float]], s: Settings) -> list[list[Node]]:
    """The same rounds where one task has all rows."""
    def fit(it: Iterator[Block]) -> Iterator[list[list[Node]]]:
        here, trees = list(it), []
        for _ in range(s.rounds):
            tree = grow(_InATask(here, [len(c) + 1 for c in cuts], s), cuts, s)
            if tree[0].feature < 0:
                break
            trees.append(tree)
            here = [b.grown(tree) for b in here]
        yield trees
    return blocks.mapPartitions(fit).first()


@dataclass
class BoostedTreesModel:
    """Fitted trees; scores by built-in expressions."""

    settings: Settings
    features_col: str
    base: float
    trees: list[list[Node]] = field(default_factory=list)
    cuts: list[list[float]] = field(default_factory=list)

    def margin(self) -> Column:
        """Margin of a row from its feature array ``_x``."""
        return F.expr(" + ".join([f"{self.base!r}D", *map(_case, self.trees)]))

    def transform(self, df: DataFrame, margin_col: str = "margin", score_col: str = "score",
                  prediction_col: str = "prediction") -> DataFrame:
        """``df`` with margin, probability of the positive class and hard prediction."""
        return (df.withColumn("_x", vector_to_array(self.features_col)).withColumn(margin_col, self.margin())
                .drop("_x")
                .withColumns({score_col: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(margin_col))),
                              prediction_col: (F.col(margin_col) > 0).cast("double")}))

    def nodes(self, spark) -> DataFrame:
        """The trees as a relation, one row per node; ``path`` is 1 at the root and 2p, 2p + 1
        at the children of p."""
        rows = []
        for t, tree in enumerate(self.trees):
            path = {0: 1}
            for k, n in enumerate(tree):
                if n.feature >= 0:
                    path[n.left], path[n.right] = 2 * path[k], 2 * path[k] + 1
                rows.append((t, path[k], n.depth, n.n, n.g, n.h, n.feature, n.cut if n.feature >= 0 else None,
                             n.gain, n.value))
        return spark.createDataFrame(rows, "tree int, path bigint, depth int, n bigint, g double, h double, "
                                           "feature int, cut double, gain double, value double")

    def to_json(self) -> str:
        return json.dumps({"settings": asdict(self.settings), "features_col": self.features_col, "base": self.base,
                           "cuts": self.cuts, "trees": [[vars(n) for n in t] for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> BoostedTreesModel:
        d = json.loads(text)
        return BoostedTreesModel(Settings(**d["settings"]), d["features_col"], d["base"],
                                 [[Node(**n) for n in t] for t in d["trees"]], d["cuts"])


class BoostedTreesClassifier:
    def __init__(self, label_col: str = "label", features_col: str = "features", **settings):
        self.label_col, self.features_col, self.settings = label_col, features_col, Settings(**settings)

    def fit(self, df: DataFrame) -> BoostedTreesModel:
        s = self.settings
        x = df.filter(F.col(self.label_col).isNotNull()).select(
            F.col(self.label_col).cast("double").alias("_y"), vector_to_array(self.features_col).alias("_x"))
        first = x.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.max(F.size("_x")).alias("d")).first()
        n, pos, dim = first["n"], first["s"] or 0.0, first["d"] or 0
        base = math.log(pos / (n - pos)) if s.from_mean and 0 < pos < n else 0.0
        model = BoostedTreesModel(s, self.features_col, base)
        if not n or not dim:
            return model
        names = [f"_x{i}" for i in range(dim)]
        wide = x.select("_y", *[F.col("_x")[i].alias(c) for i, c in enumerate(names)])
        model.cuts = cut_points(wide, names, s.bins)
        binned = Bucketizer(splitsArray=[[-math.inf, *(c or [0.0]), math.inf] for c in model.cuts], inputCols=names,
                            outputCols=[f"_b{i}" for i in range(dim)], handleInvalid="keep").transform(wide)
        # a column of one value has one bin; invalid values share the last one
        binned = rebalance(binned.select("_y", *[
            F.least(F.col(f"_b{i}").cast("int"), F.lit(len(c))).cast("smallint").alias(f"_b{i}")
            for i, c in enumerate(model.cuts)]))
        blocks = _packed(binned, dim, base)
        fit = _fit_in_a_task if blocks.getNumPartitions() == 1 else _fit_over_tasks
        model.trees = fit(blocks, model.cuts, s)
        return model

"""Forests and boosted trees from histograms of binned rows.

Spark ML's own fit holds a bag count and a node of every tree beside each row, and its tasks add to the statistics of all trees at once, row by
row. Here rows are cut into blocks of one byte a feature, written once. Bags are drawn again from a seed and nodes found again by walking the
tree, so a row costs the same whatever the number of trees; a task works on one tree and one block at a time in arrays, and holds histograms of
bounded size. What is grown follows Spark ML: candidate cuts, variance and Gini, Poisson bags, feature subsets, merged leaves; random numbers
are others. The result is one of Spark ML's models.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.ml import classification, regression
from pyspark.sql import DataFrame, functions as F

from devicehealth.session import cut_lineage, let_go, scratch_path

#: Rows of a block, rows looked at to place the cuts, and bytes of histograms a task holds at a time.
BLOCK, LOOKED_AT, HISTOGRAMS = 1 << 17, 10_000, 128 << 20
#: Trees between two reliable checkpoints of what boosted trees have predicted.
KEEP_EVERY = 10
#: Most bins of a feature, and a cut that no bin lies beyond.
MOST_BINS, STILL = 32, 255


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Candidate cuts of one feature: between all values if they are few, else at about equal shares of the weight."""
    found, at = np.unique(values, return_inverse=True)
    share = np.bincount(at, weights=weights, minlength=len(found))
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < bins:
        return middle
    stride = share.sum() / bins
    out, wanted, so_far = [], stride, share[0]
    for i in range(1, len(found)):
        before, so_far = so_far, so_far + share[i]
        if abs(before - wanted) < abs(so_far - wanted):
            out.append(middle[i - 1])
            wanted += stride
    return np.array(out)


def _packed(rows: DataFrame, features: list[str], label: str, weight: str | None, cuts: list[np.ndarray]) -> RDD:
    """Blocks ``(number, rows, bins, labels, weights)``, written once."""
    columns = [*features, label, *([weight] if weight else [])]

    def whole(parts: list[pa.RecordBatch], number: int) -> bytes:
        table = pa.Table.from_batches(parts)
        x = {c: table.column(c).to_numpy().astype(float) for c in columns}
        if any(np.isnan(v).any() for v in x.values()):
            raise ValueError("rows with a missing feature, label or weight")
        binned = np.concatenate([np.searchsorted(c, x[f], side="left").astype(np.uint8) for f, c in zip(features, cuts)])
        head = np.array([number, table.num_rows], np.int64)
        return b"".join(a.tobytes() for a in (head, x[label], *([x[weight]] if weight else []), binned))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, known, out = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            held.append(batch)
            known += batch.num_rows
            if known >= BLOCK:
                yield pa.RecordBatch.from_pydict({"block": [whole(held, first + out)]})
                held, known, out = [], 0, out + 1
        if known:
            yield pa.RecordBatch.from_pydict({"block": [whole(held, first + out)]})

    packed = cut_lineage(rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(pack, "block binary"))
    return packed.rdd.map(lambda r: bytes(r[0]))


def _unpacked(block: bytes, weighted: bool) -> tuple[int, int, np.ndarray, np.ndarray | None, np.ndarray]:
    number, n = np.frombuffer(block, np.int64, 2)
    y = np.frombuffer(block, np.float64, n, 16)
    w = np.frombuffer(block, np.float64, n, 16 + 8 * n) if weighted else None
    return int(number), int(n), y, w, np.frombuffer(block, np.uint8, offset=16 + 8 * n * (2 if weighted else 1))


def _poisson() -> np.ndarray:
    """Poisson numbers of mean 1 for 65,536 equal shares of chance."""
    chance, terms = np.exp(-1.0), []
    while len(terms) < 10:
        terms.append(chance)
        chance /= len(terms)
    return np.searchsorted(np.cumsum(terms), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


class Tree:
    """A tree as it grows: nodes in the order of levels; one without a cut stays where it is."""

    def __init__(self, number: int, channels: int):
        self.number, self.levels = number, [0]
        self.feature, self.left = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.cut, self.gain = np.full(1, STILL, np.uint8), np.full(1, -1.0)
        self.stats, self.open = np.zeros((1, channels)), np.zeros(1, np.int64)
        self.subsets: np.ndarray | None = None

    def plan(self, level: int) -> tuple:
        """What a task needs to find the open nodes and the features they ask for."""
        slot = np.full(len(self.left), -1, np.int32)
        slot[self.open] = np.arange(len(self.open))
        return self.number, level, self.feature, self.cut, self.left, slot, len(self.open), self.subsets

    def grow(self, totals: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, lefts: np.ndarray) -> None:
        """Cut the open nodes whose gain is above 0; their children are open next."""
        self.stats[self.open] = totals
        split = np.flatnonzero(gain > 0)
        at, base = self.open[split], len(self.left)
        self.feature[at], self.cut[at], self.gain[at], self.left[at] = feature[split], cut[split], gain[split], base + 2 * np.arange(len(at))
        born = np.arange(base, base + 2 * len(at))
        children = np.stack([lefts[split], totals[split] - lefts[split]], 1).reshape(2 * len(at), totals.shape[1])
        self.levels.append(base)
        self.feature, self.left = np.append(self.feature, np.zeros(len(born), np.int32)), np.append(self.left, born.astype(np.int32))
        self.cut, self.gain = np.append(self.cut, np.full(len(born), STILL, np.uint8)), np.append(self.gain, np.full(len(born), -1.0))
        self.stats, self.open = np.concatenate([self.stats, children]), born


def walk(bins: np.ndarray, n: int, rows: np.ndarray, plan: tuple) -> np.ndarray:
    """The node of each of ``rows`` after as many steps as the tree has levels."""
    _, level, feature, cut, left = plan[:5]
    start = feature.astype(np.int64) * n
    # The next node for each node and bin.
    step = (left.astype(np.int64)[:, None] + (np.arange(MOST_BINS, dtype=np.uint8)[None, :] > cut[:, None])).ravel()
    node = np.zeros(len(rows), np.int64)
    for _ in range(level):
        at = start.take(node, mode="clip")
        at += rows
        node *= MOST_BINS
        node += bins.take(at, mode="clip")
        node = step.take(node, mode="clip")
    return node


def _histogram(block: tuple, plan: tuple, out: dict, kind: tuple, label: np.ndarray, chances: np.ndarray | None) -> None:
    """Add the rows of a block to the histograms of a tree's open nodes."""
    classes, bins, last, seed, features = kind
    number, n, _, w, x = block
    tree, _, _, _, _, slot, nodes, subsets = plan
    if chances is None:
        rows, times = np.arange(n), None
    else:
        drawn = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, tree, number >> 32, number & 0xFFFFFFFF])).bytes(2 * n)
        times = chances.take(np.frombuffer(drawn, np.uint16))
        rows = np.flatnonzero(times)
        times = times.take(rows).astype(float)
    place = slot.take(walk(x, n, rows, plan))
    if len(place) and place.min() < 0:
        kept = np.flatnonzero(place >= 0)
        rows, place, times = rows.take(kept), place.take(kept), None if times is None else times.take(kept)
    if w is not None:
        times = w.take(rows) if times is None else times * w.take(rows)
    y, place = label.take(rows), place.astype(np.int64)
    size = nodes * max(classes, 1) * bins
    if classes:
        base, weighted = (place * classes + y.astype(np.int64)) * bins, [times]
    else:
        sums = y if times is None else y * times
        base, weighted = place * bins, [times, sums, *([sums * y] if last else [])]
        out["squares"] += np.bincount(place, sums * y, nodes)
    for j in range(features if subsets is None else subsets.shape[1]):
        if subsets is not None:
            at = (subsets[:, j].astype(np.int64) * n).take(place, mode="clip")
            at += rows
            column = x.take(at, mode="clip")
        else:
            column = x[j * n:(j + 1) * n] if chances is None and len(rows) == n else x[j * n:(j + 1) * n].take(rows, mode="clip")
        at = np.add(base, column)
        for c, weights in enumerate(weighted):
            out["bins"][c, j] += np.bincount(at, weights, size)


def _best(found: dict, plan: tuple, kind: tuple) -> tuple:
    """``(totals, feature, cut, gain, left totals)`` of the open nodes: what a cut takes off the variance or the Gini impurity, the first of equal ones."""
    classes, bins, last, _, _ = kind
    nodes, subsets = plan[6], plan[7]
    sums = found["bins"]
    k = sums.shape[1]
    # (channel, feature, node, bin)
    parts = np.moveaxis(sums[0].reshape(k, nodes, classes, bins), 2, 0) if classes else sums.reshape(-1, k, nodes, bins)
    below = np.cumsum(parts, axis=3)
    whole = below[..., -1:]
    count, everyone = (below.sum(0), whole.sum(0)) if classes else (below[0], whole[0])
    rest = everyone - count
    squared = lambda a: (a * a).sum(0) if classes else a[1] * a[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((count > 0) & (rest > 0), squared(below) / count + squared(whole - below) / rest, -np.inf)
    score = np.moveaxis(score, 1, 0).reshape(nodes, k * bins)
    best = score.argmax(1)
    j, cut, at = best // bins, best % bins, np.arange(nodes)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (score[at, best] - (squared(whole) / everyone)[0, :, 0]) / everyone[0, :, 0]
        totals, lefts = whole[:, 0, :, 0].T, below[:, j, at, cut].T
        if not classes:
            totals = np.column_stack([totals[:, :2], found["squares"]])
            lefts = lefts if last else np.column_stack([lefts, np.full(nodes, np.nan)])
        pure = impurity(totals, classes) < np.finfo(float).eps
    return totals, (j if subsets is None else subsets[at, j]), cut, np.where(pure | ~np.isfinite(gain), -1.0, gain), lefts


def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            return 1 - ((stats / stats.sum(1, keepdims=True)) ** 2).sum(1)
        return stats[:, 2] / stats[:, 0] - (stats[:, 1] / stats[:, 0]) ** 2


def _empty(plan: tuple, kind: tuple) -> dict:
    classes, bins, last, _, features = kind
    k = features if plan[7] is None else plan[7].shape[1]
    return {"bins": np.zeros((1 if classes else 3 if last else 2, k, plan[6] * max(classes, 1) * bins)), "squares": np.zeros(0 if classes else plan[6])}


def _bytes(tree: Tree, kind: tuple) -> int:
    classes, bins, last, _, features = kind
    k = features if tree.subsets is None else tree.subsets.shape[1]
    return 8 * len(tree.open) * k * bins * (classes or (3 if last else 2))


def _sum(into: dict, more: dict) -> dict:
    for name, a in more.items():
        into[name] += a
    return into


def _level(state: RDD, trees: list[Tree], level: int, kind: tuple, weighted: bool, aim, bagged: bool) -> None:
    """Grow ``trees`` by a level: histograms in tasks, the best cuts where the histograms of a tree meet."""
    context = state.context
    told = context.broadcast([t.plan(level) for t in trees])

    def count(parts: Iterator) -> Iterator:
        plans, chances = told.value, _poisson() if bagged else None
        found = {p[0]: _empty(p, kind) for p in plans}
        for block, scored in parts:
            unpacked = _unpacked(block, weighted)
            label = aim(unpacked[2], scored)
            for p in plans:
                _histogram(unpacked, p, found[p[0]], kind, label, chances)
        whole = bool(kind[0]) and not weighted
        for number, sums in found.items():
            yield number, sums | {"bins": sums["bins"].astype(np.int64 if sums["bins"].max(initial=0) >= 2**31 else np.int32)} if whole else sums

    def meet(parts: Iterator) -> Iterator:
        plans, met = {p[0]: p for p in told.value}, {}
        for number, sums in parts:
            met[number] = _sum(met.get(number) or _empty(plans[number], kind), sums)
        for number, sums in met.items():
            yield number, _best(sums, plans[number], kind)

    counted, places = state.mapPartitions(count), {t.number: i for i, t in enumerate(trees)}
    if len(trees) == 1:
        grown = list(meet(iter(counted.collect())))
    else:
        grown = counted.partitionBy(min(len(trees), context.defaultParallelism), lambda number: places[number]).mapPartitions(meet).collect()
    for number, best in grown:
        trees[places[number]].grow(*best)
    told.destroy()


def _subset(tree: Tree, seed: int, level: int, features: int, wanted: int) -> None:
    if wanted < features:
        rng = np.random.default_rng([seed & 0xFFFFFFFF, tree.number, level])
        tree.subsets = np.sort(rng.random((len(tree.open), features)).argsort(1)[:, :wanted], axis=1).astype(np.int32)


def _features_wanted(strategy: str, features: int, trees: int, classes: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    known = {"all": features, "sqrt": int(np.ceil(np.sqrt(features))), "onethird": int(np.ceil(features / 3)), "log2": max(1, int(np.ceil(np.log2(features))))}
    return known[strategy]


def _merged(tree: Tree, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """``(prediction, whether a node is a leaf)``; two leaves of one prediction are one, from the deepest level up."""
    with np.errstate(divide="ignore", invalid="ignore"):
        said = tree.stats.argmax(1).astype(float) if classes else tree.stats[:, 1] / tree.stats[:, 0]
    leaf = tree.gain < 0
    ends = [*tree.levels, len(leaf)]
    for a, b in reversed(list(zip(ends, ends[1:]))):
        at = np.arange(a, b)[~leaf[a:b]]
        one, two = tree.left[at], tree.left[at] + 1
        same = leaf[one] & leaf[two] & (said[one] == said[two])
        leaf[at[same]] = True
        said[at[same]] = said[one[same]]
    return said, leaf


def _nodes(tree: Tree, number: int, classes: int, cuts: list[np.ndarray]) -> pa.Table:
    """A tree in the table of nodes that Spark ML keeps."""
    said, leaf = _merged(tree, classes)
    kept = np.zeros(len(leaf), bool)
    kept[0] = True
    ends = [*tree.levels, len(leaf)]
    for a, b in zip(ends, ends[1:]):
        at = np.arange(a, b)[kept[a:b] & ~leaf[a:b]]
        kept[tree.left[at]] = kept[tree.left[at] + 1] = True
    at = np.flatnonzero(kept)
    name, inner = np.cumsum(kept) - 1, ~leaf[at]
    widest = max(map(len, cuts), default=0) + 1
    values = np.array([np.append(c, np.zeros(widest - len(c))) for c in cuts])[tree.feature[at], np.minimum(tree.cut[at], widest - 1)]
    stats = tree.stats[at]
    child = np.where(inner, name[tree.left[at]], -1).astype(np.int32)
    lists = lambda a, per: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(a))
    split = pa.StructArray.from_arrays([pa.array(np.where(inner, tree.feature[at], -1).astype(np.int32)), lists(values[inner], inner.astype(int)),
                                        pa.array(np.full(len(at), -1, np.int32))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    count = stats.sum(1) if classes else stats[:, 0]
    fields = {"id": np.arange(len(at), dtype=np.int32), "prediction": said[at], "impurity": impurity(stats, classes),
              "impurityStats": lists(stats.ravel(), np.full(len(at), stats.shape[1])), "rawCount": np.rint(count).astype(np.int64),
              "gain": np.where(inner, tree.gain[at], -1.0), "leftChild": child, "rightChild": np.where(inner, child + 1, -1).astype(np.int32), "split": split}
    data = pa.StructArray.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in fields.values()], list(fields))
    return pa.table({"treeID": pa.array(np.full(len(at), number, np.int32)), "nodeData": data})


#: Model of each estimator and the trees in it.
MODELS = {"RandomForestRegressor": (regression, "RandomForestRegressionModel", "regression.DecisionTreeRegressionModel"),
          "RandomForestClassifier": (classification, "RandomForestClassificationModel", "classification.DecisionTreeClassificationModel"),
          "GBTRegressor": (regression, "GBTRegressionModel", "regression.DecisionTreeRegressionModel"),
          "GBTClassifier": (classification, "GBTClassificationModel", "regression.DecisionTreeRegressionModel")}


def _model(spark, estimator, trees: list[Tree], weights: list[float], classes: int, cuts: list[np.ndarray], numbers: dict):
    """Spark ML's model of these trees, by way of the tables that it is stored in."""
    module, name, member = MODELS[type(estimator).__name__]
    path, ml = scratch_path(spark, "trees"), "org.apache.spark.ml."
    about = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {}}
    params = {p.name: v for p, v in estimator.extractParamMap().items() if v is not None}
    whole = about | {"class": f"{ml}{module.__name__.rsplit('.', 1)[-1]}.{name}", "uid": estimator.uid, "paramMap": params, "numFeatures": len(cuts),
                     "numTrees": len(trees)} | numbers
    shared = {k: params[k] for k in ("featuresCol", "labelCol", "maxBins", "maxDepth", "predictionCol", "seed")}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, json.dumps(about | {"class": f"{ml}{member}", "uid": f"{estimator.uid}_{i}", "paramMap": shared}), w) for i, w in enumerate(weights)],
                          "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    nodes = pa.concat_tables([_nodes(t, i, classes, cuts) for i, t in enumerate(trees)])
    spark.createDataFrame(nodes).write.parquet(f"{path}/data")
    return getattr(module, name).load(path)


def fit(estimator, rows: DataFrame, features: Sequence[str]):
    """Fit one of ``MODELS`` on plain columns; missing values raise. The label of a classifier counts from 0."""
    spark, features, kind = rows.sparkSession, list(features), type(estimator).__name__
    value = lambda name: estimator.getOrDefault(name)
    label, seed, depth = estimator.getLabelCol(), value("seed"), value("maxDepth")
    weight = value("weightCol") if estimator.isDefined("weightCol") else None
    seen = rows.select(*[F.col(c).cast("double").alias(c) for c in (*features, label, *([weight] if weight else []))]).orderBy(
        F.rand(seed)).limit(LOOKED_AT).toPandas()
    if not len(seen) or depth < 1 or value("maxBins") > MOST_BINS:
        raise ValueError("no rows to fit on, no level, or too many bins")
    bins = min(value("maxBins"), len(seen))
    shares = seen[weight].to_numpy(float) if weight else np.ones(len(seen))
    cuts = [thresholds(seen[f].to_numpy(float), shares, bins) for f in features]
    blocks = _packed(rows, features, label, weight, cuts).coalesce(spark.sparkContext.defaultParallelism)
    width = max(map(len, cuts), default=0) + 1
    if kind.startswith("GBT"):
        trees, weights = _boosted(blocks, value("maxIter"), depth, value("stepSize"), kind == "GBTClassifier", width, len(features), weight is not None)
        return _model(spark, estimator, trees, weights, 0, cuts, {})
    classes = int(blocks.map(lambda b: _unpacked(b, weight is not None)[2].max()).max()) + 1 if kind == "RandomForestClassifier" else 0
    wanted = _features_wanted(value("featureSubsetStrategy"), len(features), value("numTrees"), classes)
    trees, state = [Tree(i, classes or 3) for i in range(value("numTrees"))], blocks.map(lambda b: (b, None))
    for level in range(depth):
        about, at = (classes, width, level == depth - 1, seed, len(features)), 0
        for t in trees:
            _subset(t, seed, level, len(features), wanted)
        growing = [t for t in trees if len(t.open)]
        while at < len(growing):
            # As many trees at a time as a task has room for.
            end, held = at, 0
            while end < len(growing) and (end == at or held + _bytes(growing[end], about) <= HISTOGRAMS):
                held += _bytes(growing[end], about)
                end += 1
            _level(state, growing[at:end], level, about, weight is not None, lambda y, _: y, True)
            at = end
        let_go(spark)
    return _model(spark, estimator, trees, [1.0] * len(trees), classes, cuts, {"numClasses": classes} if classes else {})


def _boosted(blocks: RDD, rounds: int, depth: int, step: float, logistic: bool, width: int, features: int, weighted: bool) -> tuple[list[Tree], list[float]]:
    """Trees of the residuals that the ones before leave: of twice the error, or of the slope of the logistic loss; a row carries what it was predicted."""
    side = (lambda y: 2 * y - 1) if logistic else (lambda y: y)

    def aim(y: np.ndarray, scored: np.ndarray | None) -> np.ndarray:
        y = side(y)
        if scored is None:
            return y
        return 4 * y / (1 + np.exp(2 * y * scored)) if logistic else 2 * (y - scored)

    state, trees, weights = blocks.map(lambda b: (b, None)).persist(), [], []
    for number in range(rounds):
        tree = Tree(number, 3)
        for level in range(depth):
            if len(tree.open):
                _level(state, [tree], level, (0, width, level == depth - 1, 0, features), weighted, aim, False)
        trees.append(tree)
        weights.append(1.0 if number == 0 else step)
        if number == rounds - 1:
            break
        plan, said, scale = tree.plan(len(tree.levels) - 1), _merged(tree, 0)[0], weights[-1]

        def add(part, plan=plan, said=said, scale=scale):
            block, scored = part
            _, n, _, _, x = _unpacked(block, weighted)
            more = scale * said.take(walk(x, n, np.arange(n), plan))
            return block, more if scored is None else scored + more

        before, state = state, state.map(add).persist()
        if number % KEEP_EVERY == KEEP_EVERY - 1:
            state.checkpoint()
        state.count()
        before.unpersist()
    state.unpersist()
    return trees, weights

"""Random forests of any depth whose trees stay in tables.

Features are cut into at most maxBins bins, as Spark's own trees do, so a row is known by the cell that its bins name. A tree is fitted
on what it draws of each cell: at most maxBins ** features rows (2 ** 20 with four features), however many rows there are. Drawing
and adding up is done where the rows are, and each tree grows in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, factorial, frexp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from basinflow.session import scratch, ship

#: Values of a feature that are counted one by one for its cuts; of more the cuts come from approximate percentiles.
COUNTED = 4096
#: Bits of a leaf's value, so that the sum over up to 4,096 trees is exact in any order.
VALUE_BITS = 50
#: Where the share of rows drawn at most 0, 1, 2 ... times ends, in 32 bits.
DRAWN = np.array([round(sum(exp(-1) / factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)], np.uint32)
NODES = "tree int, node int, feature int, cut int, child int, value long"


class ForestParams(HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    """Named as in Spark's own forests."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest drawn rows of a child", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a feature", TypeConverters.toInt)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def getMinInstancesPerNode(self) -> int:
        return self.getOrDefault(self.minInstancesPerNode)

    def getMaxBins(self) -> int:
        return self.getOrDefault(self.maxBins)


class Forest(Estimator, ForestParams):
    """Regression by bootstrapped trees that look at all features and split by the gain in variance. A tree depends on its number
    and the seed only, so the first trees of a forest are those of a smaller one."""

    def __init__(self, inputCols: list[str], labelCol: str, numTrees: int, maxDepth: int, minInstancesPerNode: int, seed: int, maxBins: int = 32) -> None:
        super().__init__()
        self._set(inputCols=inputCols, labelCol=labelCol, numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=seed, maxBins=maxBins)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark = dataset.sparkSession
        shape = measure(dataset, self.getInputCols(), self.getLabelCol(), self.getMaxBins())
        drawn = draws(dataset, shape, self.getNumTrees(), self.getSeed())
        path, depth, least = scratch(spark, "forest"), self.getMaxDepth(), self.getMinInstancesPerNode()
        dealt(drawn, self.getNumTrees()).applyInPandas(lambda d: _grown(d, shape, depth, least), NODES).write.parquet(path)
        return self._copyValues(ForestModel(shape, path))


class ForestModel(Model, ForestParams, MLWritable, MLReadable):
    """A fitted forest: a table of nodes in the shared store, and the shape of its cells."""

    def __init__(self, shape: dict, path: str) -> None:
        super().__init__()
        self.shape, self.path = shape, path

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The rows are stored once, since their cells are looked up apart from them."""
        spark, shape, path, depth = dataset.sparkSession, self.shape, scratch(dataset.sparkSession, "cells"), self.getMaxDepth()
        ship(spark)
        with_cells(dataset, shape).write.parquet(path)
        rows = spark.read.parquet(path)
        nodes = spark.read.schema(NODES).parquet(self.path)
        asked = by_tree(rows, self.getNumTrees()).groupBy("tree").cogroup(nodes.groupBy("tree"))
        found = asked.applyInPandas(lambda a, b: _looked_up(a, b, shape, depth), "__cell long, value long")
        means = found.groupBy("__cell").agg(prediction(F.sum("value"), self.getNumTrees(), shape).alias(self.getPredictionCol()))
        return rows.join(means, "__cell").drop("__cell")

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


class ForestWriter(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"shape": self.model.shape})
        self.sparkSession.read.schema(NODES).parquet(self.model.path).write.parquet(f"{path}/nodes")


class ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        kept = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(kept["shape"], f"{path}/nodes")
        model._resetUid(kept["uid"])
        DefaultParamsReader.getAndSetParams(model, kept)
        return model


def measure(rows: DataFrame, features: list[str], label: str, bins: int) -> dict:
    """Cuts of each feature, and the label's range with the unit it is counted in: whole numbers, so that sums are exact in any order."""
    parts = [F.percentile_approx(c, [i / bins for i in range(1, bins)], 10000) for c in features]
    counts = [F.approx_count_distinct(c) for c in features]
    n, low, high, *found = rows.where(F.col(label).isNotNull()).agg(F.count("*"), F.min(label), F.max(label), *counts, *parts).first()
    if not n:
        raise ValueError("no rows to fit on")
    bits, k = (bins - 1).bit_length(), len(features)
    if bits * k > 62:
        raise ValueError(f"{k} features of {bins} bins have too many cells")
    cuts = [_cuts(rows.groupBy(c).count().collect(), bins) if found[i] <= COUNTED else sorted(set(found[k + i])) for i, c in enumerate(features)]
    centre = low / 2 + high / 2
    whole = min(VALUE_BITS, 58 - n.bit_length())
    return {"features": features, "label": label, "bits": bits, "cuts": cuts, "low": low, "high": high, "centre": centre, "reach": frexp(max(high - centre, centre - low))[1], "whole": whole}


def _cuts(counted: list, bins: int) -> list[float]:
    """Between all values if they fit into the bins; otherwise where the shares of rows come nearest to equal ones."""
    values, counts = np.array(sorted((r[0], r[1]) for r in counted)).reshape(-1, 2).T
    between = values[:-1] / 2 + values[1:] / 2
    if len(values) > bins:
        below = np.cumsum(counts)[:-1]
        between = between[np.unique(np.abs(below[:, None] - np.arange(1, bins) * counts.sum() / bins).argmin(0))]
    return [float(x) for x in np.unique(between)]


def with_cells(rows: DataFrame, shape: dict) -> DataFrame:
    """The rows with the number of their cell."""
    splits = [[float("-inf"), *(cuts or [0.0]), float("inf")] for cuts in shape["cuts"]]
    names = [f"__bin_{i}" for i in range(len(splits))]
    binned = Bucketizer(inputCols=shape["features"], outputCols=names, splitsArray=splits).transform(rows)
    cell = reduce(lambda a, b: a + b, [F.col(c).cast("long") * (1 << shape["bits"] * i) for i, c in enumerate(names)])
    return binned.withColumn("__cell", cell).drop(*names)


def draws(rows: DataFrame, shape: dict, trees: int, seed: int) -> DataFrame:
    """(tree, cell, n, total): how many rows each tree draws of a cell, with replacement, and the sum of their labels. A row is drawn
    a Poisson number of times, by a hash of its cell, label and number among equal rows, and so alike under any partitioning.
    Rows are dealt out by ranges, so that a full cell takes as many tasks as it needs and an empty one none."""
    spark = rows.sparkSession
    ship(spark)
    unit = 2.0 ** (shape["whole"] - shape["reach"])
    known = with_cells(rows.where(F.col(shape["label"]).isNotNull()), shape)
    coded = known.select(F.col("__cell").alias("cell"), F.rint((F.col(shape["label"]) - shape["centre"]) * unit).cast("long").alias("y"))
    equal = coded.groupBy("cell", "y").agg(F.count("*").alias("copies"))
    each = equal.select("cell", "y", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    dealt = each.withColumn("key", F.xxhash64(F.lit(seed), "cell", "y", "copy")).repartitionByRange("cell", "key").sortWithinPartitions("cell")
    return dealt.select("cell", "y", "key").mapInArrow(lambda batches: _drawn(batches, trees), "tree int, cell long, n long, total long")


def _drawn(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell, y, key = (c.to_numpy() for c in batch.columns)
        if not len(cell):
            continue
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        cells, out = cell[starts], []
        for tree in range(trees):
            times = poisson(key.view(np.uint64), tree)
            n = np.add.reduceat(times, starts)
            has = n > 0
            out.append((np.full(has.sum(), tree, np.int32), cells[has], n[has], np.add.reduceat(times * y, starts)[has]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["tree", "cell", "n", "total"])


def poisson(keys: np.ndarray, tree: int) -> np.ndarray:
    """Numbers of mean 1 from 64-bit keys and the tree's number, mixed as in SplitMix64."""
    z = keys + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    times = np.zeros(len(u), np.uint8)
    for bound in DRAWN:
        times += u >= bound
    return times.astype(np.int64)


def by_tree(rows: DataFrame, trees: int) -> DataFrame:
    """(tree, cells): the cells of the rows in lists of at most 4,096, once for each tree."""
    lists = rows.select("__cell").distinct().groupBy(F.shiftright("__cell", 12)).agg(F.collect_list("__cell").alias("cells"))
    return lists.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "cells")


def dealt(drawn: DataFrame, trees: int) -> GroupedData:
    """Groups by tree, dealt evenly to two tasks a core. By hash some tasks would have several times the trees of others, and Spark
    puts small partitions together by their bytes, though a tree takes far longer to grow than to read."""
    tasks = min(trees, 2 * drawn.sparkSession.sparkContext.defaultParallelism)
    return drawn.withColumn("part", F.col("tree") % tasks).repartitionById(tasks, F.col("part")).groupBy("part", "tree")


def prediction(total, trees: int, shape: dict):
    """The mean of trees' summed values; a mean lies within the labels, whatever rounding does."""
    mean = shape["centre"] + total * (2.0 ** (shape["reach"] - VALUE_BITS) / trees)
    return F.greatest(F.lit(shape["low"]), F.least(F.lit(shape["high"]), mean))


def grow(drawn: pd.DataFrame, shape: dict, depth: int, least: int) -> dict[str, np.ndarray]:
    """The nodes of one tree, level by level. A node's feature is -1 if it is a leaf; bins up to its cut go to its child, others to
    the one after. Ties go to the first feature and the lowest cut. A tree that draws nothing answers with the middle of the labels."""
    if drawn.empty:
        return {"feature": np.full(1, -1, np.int32), **{c: np.zeros(1, np.int64) for c in ("cut", "child", "value")}}
    drawn = drawn.groupby("cell")[["n", "total"]].sum()
    cell, n, total = drawn.index.to_numpy(), drawn["n"].to_numpy(), drawn["total"].to_numpy()
    bits, k = shape["bits"], len(shape["cuts"])
    x = np.array([cell >> (bits * f) & ((1 << bits) - 1) for f in range(k)], np.int64)
    at, sums, levels, made = np.zeros(len(cell), np.int64), (np.array([n.sum()]), np.array([total.sum()])), [], 1
    for level in range(depth + 1):
        count, amount = sums
        feature, cut, child = np.full(len(count), -1, np.int32), np.zeros(len(count), np.int32), np.zeros(len(count), np.int32)
        value = np.rint(amount / count * 2.0 ** (VALUE_BITS - shape["whole"])).astype(np.int64)
        levels.append((feature, cut, child, value))
        opened = (np.bincount(at, minlength=len(count)) > 1) & (count >= 2 * least) & (level < depth)
        inside = opened[at]
        x, n, total, at = x[:, inside], n[inside], total[inside], (np.cumsum(opened) - 1)[at[inside]]
        if not len(at):
            break
        best, split = best_splits(x, n, total, at, count[opened], amount[opened], bits, least)
        ids, parted = np.flatnonzero(opened), best >= 0
        feature[ids[parted]], cut[ids[parted]] = best[parted], split[parted]
        child[ids[parted]] = made + 2 * np.arange(parted.sum())
        inside = parted[at]
        x, n, total, at = x[:, inside], n[inside], total[inside], at[inside]
        right = x[best[at], np.arange(len(at))] > split[at]
        at = 2 * (np.cumsum(parted) - 1)[at] + right
        made += 2 * parted.sum()
        if not len(at):
            break
        order = np.argsort(at)
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        sums = tuple(np.add.reduceat(v[order], starts) for v in (n, total))
    return dict(zip(("feature", "cut", "child", "value"), (np.concatenate(c) for c in zip(*levels))))


def best_splits(x, n, total, at, count, amount, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of each node's largest gain; feature -1 where nothing is gained. Cells come with the node they are in."""
    best, split, most = np.full(len(count), -1), np.zeros(len(count), np.int64), np.zeros(len(count))
    for f in range(len(x)):
        key = at << bits | x[f]
        order = np.argsort(key)
        key = key[order]
        ends = np.flatnonzero(np.diff(key, append=-1))
        node = key[ends] >> bits
        ln, ls = np.cumsum(n[order])[ends] - (np.cumsum(count) - count)[node], np.cumsum(total[order])[ends] - (np.cumsum(amount) - amount)[node]
        rn, rs = count[node] - ln, amount[node] - ls
        left, right = ls / ln, rs / np.maximum(rn, 1)
        fair = (ln >= least) & (rn >= least) & (np.abs(left - right) > 1e-14 * (np.abs(left) + np.abs(right)))
        gain = np.where(fair, (left - right) ** 2 * ln * rn / count[node], 0.0)
        top = np.maximum.reduceat(gain, np.flatnonzero(np.diff(node, prepend=-1)))
        hits = np.flatnonzero(gain == top[node])[::-1]
        first = np.empty(len(count), np.int64)
        first[node[hits]] = hits
        better = top > most
        best[better], split[better], most[better] = f, (key[ends] & ((1 << bits) - 1))[first[better]], top[better]
    return best, split


def walk(tree: dict[str, np.ndarray], cells: np.ndarray, shape: dict, depths: list[int]) -> list[np.ndarray]:
    """Values of cells where the tree ends at each of the depths, in rising order."""
    at, out, level = np.zeros(len(cells), np.int64), [], 0
    for depth in depths:
        while level < depth:
            feature = tree["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            over = (cells >> (shape["bits"] * np.maximum(feature, 0)) & ((1 << shape["bits"]) - 1)) > tree["cut"][at]
            at, level = np.where(inner, tree["child"][at] + over, at), level + 1
        out.append(tree["value"][at])
    return out


def _grown(drawn: pd.DataFrame, shape: dict, depth: int, least: int) -> pd.DataFrame:
    tree = grow(drawn, shape, depth, least)
    return pd.DataFrame({"tree": drawn["tree"].iloc[0], "node": np.arange(len(tree["value"]), dtype=np.int32), **tree})


def _looked_up(asked: pd.DataFrame, nodes: pd.DataFrame, shape: dict, depth: int) -> pd.DataFrame:
    if asked.empty:
        return pd.DataFrame({"__cell": np.empty(0, np.int64), "value": np.empty(0, np.int64)})
    nodes, cells = nodes.sort_values("node"), np.concatenate(asked["cells"].to_numpy())
    tree = {c: nodes[c].to_numpy() for c in ("feature", "cut", "child", "value")} if len(nodes) else grow(nodes, shape, depth, 1)
    return pd.DataFrame({"__cell": cells, "value": walk(tree, cells, shape, [depth])[0]})


def searched(train: DataFrame, held: DataFrame, shape: dict, trees: list[int], depths: list[int], leasts: list[int], seed: int) -> DataFrame:
    """Held-out rows with their predictions by each setting, columns p_<trees>_<depth>_<least>. A smaller forest is the first trees of
    a larger one and a shallower tree the top of a deeper one, so each tree grows once for each least number of rows."""
    path, spark = scratch(train.sparkSession, "held"), train.sparkSession
    ship(spark)
    with_cells(held, shape).write.parquet(path)
    rows, deep = spark.read.parquet(path), sorted(set(depths))
    names = [f"v_{d}_{m}" for m in leasts for d in deep]
    drawn = draws(train, shape, max(trees), seed)
    both = by_tree(rows, max(trees)).groupBy("tree").cogroup(drawn.groupBy("tree"))
    found = both.applyInPandas(lambda a, b: _tried(a, b, shape, deep, leasts), f"tree int, __cell long, {', '.join(f'{c} long' for c in names)}")
    settings = [(t, d, m) for t in trees for d in depths for m in leasts]
    means = found.groupBy("__cell").agg(*[prediction(F.sum(F.when(F.col("tree") < t, F.col(f"v_{d}_{m}"))), t, shape).alias(f"p_{t}_{d}_{m}") for t, d, m in settings])
    return rows.join(means, "__cell").drop("__cell")


def _tried(asked: pd.DataFrame, drawn: pd.DataFrame, shape: dict, depths: list[int], leasts: list[int]) -> pd.DataFrame:
    names = [f"v_{d}_{m}" for m in leasts for d in depths]
    if asked.empty:
        return pd.DataFrame({"tree": np.empty(0, np.int32), **{c: np.empty(0, np.int64) for c in ("__cell", *names)}})
    cells = np.concatenate(asked["cells"].to_numpy())
    values = [v for m in leasts for v in walk(grow(drawn, shape, depths[-1], m), cells, shape, depths)]
    return pd.DataFrame({"tree": asked["tree"].iloc[0], "__cell": cells, **dict(zip(names, values))})

"""Boosted trees over factors: selection by gain, scores, and what each factor adds to a row's score.

Spark's own gradient boosting grows the trees; its saved nodes are the table that everything else is read from. A score
is a sum of nested CASE expressions, one a tree, so it needs no Python and can be written as SQL. A factor's part of a
score is what the expected value changes by at each split on the row's path that asks for it; with the trees' first
values (the base) these parts add up to the score. (Not Shapley values: those share a change among orders of asking.)

Rows with a missing factor or label are not learnt from. In scoring a missing value goes to the right side of a split.
The number of nodes, iterations times two to the depth, bounds what reaches the driver and what is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..plans import blocks
from ..sources.shared import folder


@dataclass
class Node:
    factor: str | None  # of a leaf None
    threshold: float | None
    left: int
    right: int
    value: float  # the tree's prediction at this node times the tree's weight
    gain: float  # what a split takes from the sum of squared errors


@dataclass
class Trees:
    names: list[str]
    trees: list[dict[int, Node]]

    @property
    def base(self) -> float:
        return sum(t[0].value for t in self.trees)

    def table(self, spark) -> DataFrame:
        """(tree, node, factor, threshold, left, right, value, gain)."""
        rows = [(k, i, n.factor, n.threshold, n.left, n.right, n.value, n.gain) for k, t in enumerate(self.trees) for i, n in t.items()]
        return spark.createDataFrame(rows, "tree int, node int, factor string, threshold double, left int, right int, value double, gain double")

    @classmethod
    def of_table(cls, nodes: DataFrame, names: list[str]) -> Trees:
        trees: dict[int, dict[int, Node]] = {}
        for r in nodes.collect():  # a row a node
            trees.setdefault(r["tree"], {})[r["node"]] = Node(r["factor"], r["threshold"], r["left"], r["right"], r["value"], r["gain"])
        return cls(names, [trees[k] for k in sorted(trees)])


def grow(rows: DataFrame, names: list[str], label: str = "fwd", iterations: int = 20, depth: int = 4, least_rows: int = 20, rate: float = 0.1, seed: int = 42) -> Trees:
    """The trees fitted to rows; none if there are no whole rows or the label is always the same."""
    whole = rows.select(label, *names).dropna()
    spread = whole.agg(F.count("*"), F.min(label), F.max(label)).first()
    if spread[0] < 2 or spread[1] == spread[2]:
        return Trees(names, [])
    vectors = VectorAssembler(inputCols=names, outputCol="_features").transform(whole).select("_features", F.col(label).cast("double").alias("_label"))
    model = GBTRegressor(featuresCol="_features", labelCol="_label", maxIter=iterations, maxDepth=depth, minInstancesPerNode=least_rows, stepSize=rate, seed=seed).fit(vectors)
    spark, path = rows.sparkSession, folder(rows.sparkSession, "trees")
    model.save(path)
    trees: list[dict[int, Node]] = [{} for _ in model.treeWeights]
    for r in spark.read.parquet(f"{path}/data").collect():  # a row a node
        n, weight = r["nodeData"], model.treeWeights[r["treeID"]]
        leaf = n["leftChild"] < 0
        split = (None, None) if leaf else (names[n["split"]["featureIndex"]], n["split"]["leftCategoriesOrThreshold"][0])
        trees[r["treeID"]][n["id"]] = Node(*split, n["leftChild"], n["rightChild"], n["prediction"] * weight, 0.0 if leaf else n["gain"] * n["rawCount"])
    return Trees(names, trees)


def importances(trees: Trees) -> dict[str, float]:
    """Each factor's share of all gain; zeros if nothing was gained."""
    own = dict.fromkeys(trees.names, 0.0)
    for node in (n for t in trees.trees for n in t.values() if n.factor):
        own[node.factor] += node.gain
    total = sum(own.values())
    return {k: v / total if total > 1e-12 else 0.0 for k, v in own.items()}


def picked(trees: Trees, top: int = 20, least_ratio: float = 0.01) -> list[tuple[str, float]]:
    """The factors of largest gain, at most top, each with at least least_ratio of the first one's."""
    ranked = sorted(importances(trees).items(), key=lambda x: (-x[1], x[0]))
    best = ranked[0][1] if ranked else 0.0
    return [(k, v) for k, v in ranked[:top] if v > 0 and v >= best * least_ratio]


def _case(tree: dict[int, Node], at: int, of) -> Column:
    node = tree[at]
    if node.factor is None:
        return F.lit(of(at, node))
    return F.when(F.col(node.factor) <= node.threshold, _case(tree, node.left, of)).otherwise(_case(tree, node.right, of))


def score(trees: Trees) -> Column:
    """The prediction as one expression over the factors' columns."""
    out = F.lit(0.0)
    for tree in trees.trees:
        out = out + _case(tree, 0, lambda _, node: node.value)
    return out


def paths(trees: Trees) -> list[tuple[int, int, str, float]]:
    """(tree, leaf, factor, part): what a factor adds on the way to each leaf."""
    out = []

    def walk(k: int, tree: dict[int, Node], at: int, parts: dict[str, float]):
        node = tree[at]
        if node.factor is None:
            out.extend((k, at, f, v) for f, v in parts.items())
            return
        for to in (node.left, node.right):
            walk(k, tree, to, parts | {node.factor: parts.get(node.factor, 0.0) + tree[to].value - node.value})

    for k, tree in enumerate(trees.trees):
        walk(k, tree, 0, {})
    return out


def _leaves(tree: dict[int, Node], columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The leaf of each of n rows; what is missing goes to the right."""
    out = np.zeros(n, dtype=np.int64)

    def walk(at: int, rows: np.ndarray) -> None:
        node = tree[at]
        if node.factor is None:
            out[rows] = at
            return
        low = columns[node.factor][rows] <= node.threshold
        walk(node.left, rows[low])
        walk(node.right, rows[~low])

    walk(0, np.arange(n))
    return out


def explained(rows: DataFrame, trees: Trees, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, nth, factor, part, score): of each row the factors that its paths ask for, those of largest part first, at
    most so many. A row's trees are walked where it lies, so nothing is exchanged and nothing but the trees is sent."""
    of: list[dict[int, list]] = [{} for _ in trees.trees]
    for k, leaf, factor, part in paths(trees):
        of[k].setdefault(leaf, []).append((factor, part))
    names = sorted({n.factor for t in trees.trees for n in t.values() if n.factor})
    own, doubles = blocks.packed(rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(n).cast("double").alias(n) for n in names)))
    types = [rows.schema[k].dataType for k in keys]
    schema = StructType([*(StructField(k, t) for k, t in zip(keys, types)), StructField("nth", IntegerType()), StructField("factor", StringType()), StructField("part", DoubleType()), StructField("score", DoubleType())])

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, n = blocks.unpacked(pa.Table.from_batches([batch]), doubles), batch.num_rows
            if not n or not names:
                continue
            columns = {name: table.column(name).to_numpy() for name in names}
            parts, asked, score = np.zeros((n, len(names))), np.zeros((n, len(names)), dtype=bool), np.zeros(n)
            for tree, ways in zip(trees.trees, of):
                leaves = _leaves(tree, columns, n)
                for leaf in np.unique(leaves).tolist():
                    at = leaves == leaf
                    score[at] += tree[leaf].value
                    for factor, part in ways.get(leaf, []):
                        k = names.index(factor)
                        parts[at, k] += part
                        asked[at, k] = True
            order = np.argsort(np.where(asked, -np.abs(parts), np.inf), axis=1, kind="stable")  # names are in order already
            found = np.minimum(asked.sum(axis=1), len(names) if most is None else most)
            row = np.repeat(np.arange(n), found)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
            which = order[row, nth]
            take = pa.array(row)
            out = {k: table.column(f"_k{i}").take(take) for i, k in enumerate(keys)}
            out |= {"nth": pa.array(nth + 1, pa.int32()), "factor": pa.array(names, pa.string()).take(pa.array(which)), "part": parts[row, which], "score": score[row]}
            yield from pa.table(out).combine_chunks().to_batches()

    return own.mapInArrow(of_batches, schema)


def contributions(rows: DataFrame, trees: Trees, keys: list[str]) -> DataFrame:
    """(keys, factor, part) of each row and factor that its paths ask for; base and parts are the score."""
    return explained(rows, trees, keys).select(*keys, "factor", "part")


def weights(rows: DataFrame, trees: Trees, keys: list[str]) -> DataFrame:
    """(factor, weight): the mean size of each factor's part over rows."""
    n = max(1, rows.count())
    found = contributions(rows, trees, keys).groupBy("factor").agg((F.sum(F.abs("part")) / n).alias("weight"))
    every = rows.sparkSession.createDataFrame([(f,) for f in trees.names], "factor string")
    return every.join(found, "factor", "left").select("factor", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def top_contributions(rows: DataFrame, trees: Trees, keys: list[str], n: int = 8) -> DataFrame:
    """(keys, nth, factor, part): of each row the n factors whose parts are largest in size."""
    return explained(rows, trees, keys, n).select(*keys, "nth", "factor", "part")

"""Histogram gradient boosting for two classes: binned features, leaf-wise trees, l2 in gain and leaf value.

A tree needs, for its leaves, the sums of gradients and hessians by feature and bin. Every step is one aggregation over
all rows: a task sums its rows in arrays, and what it found is merged by (leaf, feature, bin); both are bounded by leaves,
features and bins. Trees go to the tasks as data, so that the plans of all steps are alike, short and compiled once. The tree grows best first: of all leaves the split with the largest gain is made next. A step prepares the children
of every leaf that may be split, so that a tree takes about as many steps as it has levels, not leaves; of two children
only the left is summed, the right is what remains of the parent. Rows keep their bins; a round scores them by its trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, LEAST_HESSIAN = 255, 1e-3


@dataclass
class Node:
    """Sums of a node's rows by feature and bin (gradient, hessian, rows), its best split, and its children once they are prepared."""

    sums: np.ndarray
    split: tuple[float, int, int] | None = None
    left: int | None = None
    right: int | None = None

    def total(self) -> np.ndarray:
        return self.sums[:, 0, :].sum(axis=1)


@dataclass
class Tree:
    """Nodes by number, 0 is the root; value has the leaves' values."""

    nodes: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def leaves(self, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf's number and its rows."""
        waiting = [(0, np.arange(len(bins)))]
        while waiting:
            node, rows = waiting.pop()
            if node not in self.nodes:
                yield node, rows
                continue
            feature, cut, left, right = self.nodes[node]
            low = bins[rows, feature] <= cut
            waiting += [(left, rows[low]), (right, rows[~low])]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for leaf, rows in self.leaves(bins):
            out[rows] = self.value[leaf]
        return out


def unpacked(bins: pd.Series, width: int) -> np.ndarray:
    """The rows of bins, one byte a feature."""
    return np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), width)


def best_split(sums: np.ndarray, l2: float, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left side) of the split with the largest gain above 0, the first of equal ones."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    whole = sums.sum(axis=2, keepdims=True)
    right = whole - left
    score = lambda s: s[0] ** 2 / np.maximum(s[1] + l2, 1e-300)
    gain = score(left) + score(right) - score(whole)
    fits = (left[2] >= least) & (right[2] >= least) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    gain = np.where(fits, gain, -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    feature, cut = divmod(at, gain.shape[1]) if gain.size else (0, 0)
    return (float(gain[feature, cut]), feature, cut) if gain.size and gain[feature, cut] > 1e-12 else None


class HistBoosting:
    """fit(df) takes numeric columns without nulls, a label 0 or 1 and perhaps a weight; transform adds the probability p of label 1."""

    def __init__(self, columns: list[str], rounds: int = 100, rate: float = 0.05, leaves: int = 31, l2: float = 0.0, least: int = 20, label: str = "label", weight: str | None = None):
        self.columns, self.rounds, self.rate, self.leaves, self.l2, self.least, self.label, self.weight = columns, rounds, rate, leaves, l2, least, label, weight
        self.trees: list[Tree] = []
        self.cuts: list[np.ndarray] = []
        self.base = 0.0

    def bins_of(self, values: np.ndarray) -> np.ndarray:
        """The bin of each value: how many of its column's cuts lie below it."""
        return np.stack([np.searchsorted(cuts, values[:, j]) for j, cuts in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def fit(self, df: DataFrame) -> HistBoosting:
        shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
        found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10 * BINS).alias(f"c{i}") for i, c in enumerate(self.columns)]).first()
        self.cuts = [np.unique(np.array(x or [], float)) for x in found]
        weight = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        given = df.select(F.col(self.label).cast("int").alias("y"), weight.alias("w"), F.array(*[F.col(c).cast("double") for c in self.columns]).alias("x"))

        def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b[["y", "w"]].assign(bins=[r.tobytes() for r in self.bins_of(np.stack(b["x"]))])

        rows = given.mapInPandas(binned, "y int, w double, bins binary").persist()
        scored = None
        try:
            good, bad = rows.agg(F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * (1 - F.col("y")))).first()
            if not good or not bad:
                raise ValueError("boosting needs rows of both classes")
            self.base = float(np.log(good / bad))
            for _ in range(self.rounds):
                # from the trees and the bins, not from the round before: a plan stays as short as the first, and so does what a lost executor costs
                scored = rows.mapInPandas(self._scorer(), "y int, w double, bins binary, score double").persist()
                tree = self._grow(scored)
                scored.unpersist()
                self.trees.append(tree)
                if len(tree.value) == 1:
                    break  # nothing is left to split
        finally:
            for held in (rows, scored):
                if held is not None:
                    held.unpersist()
        return self

    def _scorer(self):
        base, trees, width = self.base, list(self.trees), len(self.columns)

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    bins = unpacked(b["bins"], width)
                    yield b.assign(score=base + sum(t.predict(bins) for t in trees))

        return of

    def _sums(self, rows: DataFrame, nodes: dict[int, tuple[int, int, int, int]], wanted: list[int]) -> dict[int, np.ndarray]:
        """Gradient, hessian and rows by feature and bin of some leaves."""
        tree, shape = Tree(nodes), (len(wanted), len(self.columns), BINS)

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, out = {n: i for i, n in enumerate(wanted)}, np.zeros((3, *shape))
            for b in batches:
                if not len(b):
                    continue
                bins, w, y, p = unpacked(b["bins"], shape[1]), b["w"].to_numpy(), b["y"].to_numpy(), 1 / (1 + np.exp(-b["score"].to_numpy()))
                g, h = w * (p - y), w * p * (1 - p)
                for leaf, own in tree.leaves(bins):
                    if leaf in place and len(own):
                        for f in range(shape[1]):
                            for i, values in enumerate((g[own], h[own], None)):
                                out[i, place[leaf], f] += np.bincount(bins[own, f], values, BINS)
            at = np.nonzero(out[2])
            yield pd.DataFrame(dict(zip(("place", "feature", "bin"), at)) | {"g": out[0][at], "h": out[1][at], "n": out[2][at]})

        parts = rows.mapInPandas(summed, "place int, feature int, bin int, g double, h double, n double")
        found = parts.groupBy("place", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        out = np.zeros((3, *shape))
        out[:, *[found[c].to_numpy() for c in ("place", "feature", "bin")]] = [found[c].to_numpy() for c in "ghn"]
        return {n: out[:, i] for i, n in enumerate(wanted)}

    def _grow(self, rows: DataFrame) -> Tree:
        prepared = {0: Node(self._sums(rows, {}, [0])[0])}
        prepared[0].split = best_split(prepared[0].sums, self.l2, self.least)
        while True:
            tree, missing = self._best_first(prepared)
            if not missing:
                for leaf in tree.value:
                    g, h, _ = prepared[leaf].total()
                    tree.value[leaf] = float(-self.rate * g / (h + self.l2)) if h + self.l2 else 0.0
                return tree
            fresh = {}
            for leaf in missing:  # the children of each of these leaves, by one aggregation
                node = prepared[leaf]
                node.left, node.right = len(prepared) + 2 * len(fresh), len(prepared) + 2 * len(fresh) + 1
                fresh[node.left] = leaf
            nodes = {n: (x.split[1], x.split[2], x.left, x.right) for n, x in prepared.items() if x.left is not None}
            for left, sums in self._sums(rows, nodes, list(fresh)).items():
                parent = prepared[fresh[left]]
                for number, own in ((left, sums), (parent.right, parent.sums - sums)):
                    prepared[number] = Node(own, best_split(own, self.l2, self.least))

    def _best_first(self, prepared: dict[int, Node]) -> tuple[Tree, list[int]]:
        """The tree as far as the children of its splits are prepared, and if a split lacks them all leaves that may be split."""
        tree = Tree(value={0: 0.0})
        while len(tree.value) < self.leaves:
            able = [n for n in tree.value if prepared[n].split]
            if not able:
                break
            best = max(able, key=lambda n: (prepared[n].split[0], -n))
            node = prepared[best]
            if node.left is None:
                return tree, [n for n in able if prepared[n].left is None]
            tree.nodes[best] = (node.split[1], node.split[2], node.left, node.right)
            del tree.value[best]
            tree.value |= {node.left: 0.0, node.right: 0.0}
        return tree, []

    def scores(self, values: np.ndarray) -> np.ndarray:
        """The probabilities of rows of values."""
        bins = self.bins_of(values)
        return 1 / (1 + np.exp(-(self.base + sum(t.predict(bins) for t in self.trees))))

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        model = self

        @F.pandas_udf("double")  # type: ignore[call-overload]
        def p(x: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.stack(x))) if len(x) else pd.Series([], dtype=float)

        return df.withColumn(out, p(F.array(*[F.col(c).cast("double") for c in self.columns])))

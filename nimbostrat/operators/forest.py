"""Snow ratios from fitted models: a linear model and forests of node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbostrat.functions.winter import linear_ratio

# The western linear model's features, coefficients and area.
WESTERN_FEATURES = ["t_04k", "t_24k", "spd_04k", "spd_24k"]
WESTERN_INTERCEPT = 175.77922006647756
WESTERN_COEFFICIENTS = [-0.5658923009849022, -0.03800487156496504, -0.2584244800211978, -0.033285591001853895]
WESTERN_MOST_LONGITUDE, WESTERN_LEAST_HEIGHT = -103.0, 1000.0


def western_ratio(longitude: Column, height: Column) -> Column:
    """The linear model's ratio; missing outside high western terrain."""
    ratio = linear_ratio(WESTERN_INTERCEPT, WESTERN_COEFFICIENTS, [F.col(c) for c in WESTERN_FEATURES])
    return F.when((longitude <= WESTERN_MOST_LONGITUDE) & (height >= WESTERN_LEAST_HEIGHT), ratio)


@dataclass(frozen=True)
class Tree:
    """Node arrays; a node with a negative child is a leaf."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """All rows go down together; one whose feature is missing has no value."""
        node, out = np.zeros(len(rows), np.int64), np.full(len(rows), np.nan)
        live = np.arange(len(rows))
        while len(live):
            leaf = (self.left[node[live]] < 0) | (self.right[node[live]] < 0)
            out[live[leaf]] = self.value[node[live[leaf]]]
            live = live[~leaf]
            x = rows[live, self.feature[node[live]]]
            live, x = live[np.isfinite(x)], x[np.isfinite(x)]
            at = node[live]
            node[live] = np.where(x <= self.threshold[at], self.left[at], self.right[at])
        return out


def forest_ratio(cells: DataFrame, trees: list[Tree], features: list[str], name: str = "ratio") -> DataFrame:
    """``cells`` with the mean of the trees that have a value; a forest has a fixed size and is broadcast."""
    shared = cells.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
        votes = np.array([t.predict(rows) for t in shared.value])
        n = np.isfinite(votes).sum(axis=0)
        return pd.Series(np.where(n > 0, np.nansum(votes, axis=0) / np.maximum(n, 1), np.nan))

    value = predict(*[F.col(c).cast("double") for c in features])
    return cells.withColumn(name, value).withColumn(name, F.when(~F.isnan(name), F.col(name)))


#: Nodes of a forest that is broadcast at most, about 40 bytes each; trees that are alike count once.
MOST_NODES = 4_000_000
#: Walks of cells down trees that are held at once, about 60 bytes each.
WALKS = 1 << 18
#: Cells that walk together.
WALKERS = 1024


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in one set of arrays; a node with a negative child is a leaf, a tree votes ``weights`` times."""

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    weights: np.ndarray

    def votes(self, rows: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """(cells, trees): every cell goes down the trees at once, one level a step; a missing feature ends without a vote."""
        node = np.broadcast_to(roots, (len(rows), len(roots))).copy()
        live, each = np.ones(node.shape, bool), np.arange(len(rows))[:, None]
        while True:
            inner = live & (self.left[node] >= 0) & (self.right[node] >= 0)
            if not inner.any():
                return np.where(live, self.value[node], np.nan)
            x = rows[each, np.where(inner, self.feature[node], 0)]
            live &= ~(inner & ~np.isfinite(x))
            below = np.where(x <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner & live, below, node)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """The mean of the trees that vote, missing if none does; cells and trees meet in blocks of ``WALKS``."""
        total, n = np.zeros(len(rows)), np.zeros(len(rows))
        width = max(WALKS // WALKERS, 1)
        for start in range(0, len(rows), WALKERS):
            some = slice(start, start + WALKERS)
            for k in range(0, len(self.roots), width):
                votes, weights = self.votes(rows[some], self.roots[k : k + width]), self.weights[k : k + width]
                known = np.isfinite(votes)
                n[some] += known @ weights
                total[some] += np.where(known, votes, 0.0) @ weights
        return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def forest_from_table(nodes: DataFrame) -> Forest:
    """A forest from rows of tree, node, left, right, feature, threshold and value.

    A tree's root is its smallest node; a missing or negative child, or one that isn't there,
    makes a leaf. Trees of the same nodes are kept once, with their number. More than
    ``MOST_NODES`` nodes of different trees are refused before any is read.
    """
    node = ["node", "left", "right", "feature", "threshold", "value"]
    alike = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct(*node))).alias("nodes")).groupBy("nodes").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    count = alike.agg(F.sum(F.size("nodes"))).first()[0] or 0
    if count > MOST_NODES:
        raise ValueError(f"a forest of more than {MOST_NODES} nodes is too large to broadcast")
    rows = alike.withColumn("tree", F.monotonically_increasing_id()).select("tree", "weight", F.explode("nodes").alias("x")).select("tree", "weight", *[f"x.{c}" for c in node])
    table = rows.toPandas().sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
    place = pd.Series(np.arange(len(table)), index=pd.MultiIndex.from_frame(table[["tree", "node"]]))

    def child(column: str) -> np.ndarray:
        wanted = pd.MultiIndex.from_arrays([table["tree"], table[column].fillna(-1).astype("int64")])
        return place.reindex(wanted).fillna(-1).to_numpy(np.int64)

    number = lambda c: table[c].to_numpy(float, na_value=np.nan)
    roots = np.flatnonzero(~table["tree"].duplicated().to_numpy())
    return Forest(roots, child("left"), child("right"), table["feature"].fillna(0).to_numpy(np.int64), number("threshold"), number("value"), table["weight"].to_numpy(float)[roots])


def forest_values(cells: DataFrame, forest: Forest, features: str = "features", name: str = "ratio") -> DataFrame:
    """``cells`` with the forest's mean over an array column of features; null where that is null or no tree votes."""
    shared = cells.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def predict(rows: pd.Series) -> pd.Series:
        out, given = np.full(len(rows), np.nan), np.flatnonzero(rows.notna().to_numpy())
        if len(given):
            out[given] = shared.value.predict(np.stack([np.asarray(r, float) for r in rows.iloc[given]]))
        return pd.Series(out)

    return cells.withColumn(name, predict(F.col(features).cast("array<double>"))).withColumn(name, F.when(~F.isnan(name), F.col(name)))

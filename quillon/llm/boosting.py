"""Gradient-boosted trees in DataFrame operations: histograms are aggregates, trees are CASE expressions.

A tree is grown level by level.  Each level is one aggregate over all labelled rows, of gradients by node, feature
and bin; the driver sees as many sums as that has cells and picks the splits.  Features are whole numbers and gradients are
rounded to whole numbers before they are summed, so a model doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, passing

#: Gradients are summed in these units.
UNIT = 1 << 20
#: Bins of a feature.
BINS = 32


@dataclass(frozen=True)
class Leaf:
    value: float

    def column(self) -> Column:
        return F.lit(self.value)


@dataclass(frozen=True)
class Fork:
    """Rows whose feature is at most ``bound`` go to ``low``."""

    feature: str
    bound: int
    low: Fork | Leaf
    high: Fork | Leaf

    def column(self) -> Column:
        return F.when(F.col(self.feature) <= self.bound, self.low.column()).otherwise(self.high.column())


@dataclass(frozen=True)
class Model:
    trees: tuple
    base: float

    def margin(self) -> Column:
        return sum((t.column() for t in self.trees), F.lit(self.base))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _bounds(rows: DataFrame, features: list[str]) -> dict[str, list[int]]:
    """For each feature the values up to which its bins reach, the last bin having no bound: exact quantiles."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[F.percentile(f, shares).alias(f) for f in features]).first()
    return {f: sorted({int(x // 1) for x in found[f] or []}) for f in features}


def _bin(feature: str, bounds: list[int]) -> Column:
    """How many bounds a feature's value is above."""
    value = F.col(feature)
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: value > b)) if bounds else F.lit(0)


def fit(labelled: DataFrame, features: list[str], label: str, trees: int = 12, depth: int = 3, rate: float = 0.5, damping: float = 1.0) -> Model:
    """A model of P(label = 1) from whole-number features; logistic loss, second-order steps."""
    spark = labelled.sparkSession
    with passing(spark):
        rows = durable(labelled.select(*[F.col(f).cast("long").alias(f) for f in features], F.col(label).cast("double").alias("y")), "labelled")
        bounds = _bounds(rows, features)
        places = [F.struct(F.lit(i).alias("feature"), _bin(f, bounds[f]).alias("bin")) for i, f in enumerate(features)]
        rows = durable(rows.withColumn("places", F.array(*places)), "binned")
        share = rows.agg(F.avg("y")).first()[0]
        if share is None or share in (0.0, 1.0):
            return Model((), 0.0 if share is None else (6.0 if share else -6.0))
        model = Model((), round(math.log(share / (1 - share)), 4))
        rows = rows.withColumn("margin", F.lit(model.base))
        for _ in range(trees):
            p = 1 / (1 + F.exp(-F.col("margin")))
            # Written tree by tree: what a round reads is one column, whatever the number of trees.
            rows = durable(rows.withColumn("g", F.floor((F.col("y") - p) * UNIT)).withColumn("h", F.floor(p * (1 - p) * UNIT)), "gradients")
            tree = _grown(rows, features, bounds, depth, rate, damping)
            rows, model = rows.withColumn("margin", F.col("margin") + tree.column()), Model((*model.trees, tree), model.base)
        return model


def _grown(rows: DataFrame, features: list[str], bounds: dict, depth: int, rate: float, damping: float):
    """One more tree, for the gradients (g, h) that the trees before it leave."""
    # A node is known by its path; a fork, once picked, is (feature, bound), a node without one is a leaf.
    forks: dict[int, tuple[str, int]] = {}
    values: dict[int, float] = {}
    alive = [1]
    for _ in range(depth):
        if not alive:
            break
        node = _node_of(forks, 1)
        held = rows.withColumn("node", node).where(F.col("node").isin(alive))
        cells = held.select("node", "g", "h", F.explode("places").alias("at")).groupBy("node", "at.feature", "at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        upcoming = []
        for k in alive:
            split = _best([c for c in cells if c["node"] == k], features, bounds, damping)
            if split is None:
                continue
            feature, bound, low, high = split
            forks[k] = (feature, bound)
            for child, (g, h) in ((2 * k, low), (2 * k + 1, high)):
                values[child] = round(rate * g / (h + damping * UNIT), 6)
                upcoming.append(child)
        alive = upcoming
    return _tree(forks, values, 1)


def _node_of(forks: dict, k: int) -> Column:
    if k not in forks:
        return F.lit(k)
    feature, bound = forks[k]
    return F.when(F.col(feature) <= bound, _node_of(forks, 2 * k)).otherwise(_node_of(forks, 2 * k + 1))


def _tree(forks: dict, values: dict, k: int):
    if k not in forks:
        return Leaf(values.get(k, 0.0))
    feature, bound = forks[k]
    return Fork(feature, bound, _tree(forks, values, 2 * k), _tree(forks, values, 2 * k + 1))


def _best(cells: list, features: list[str], bounds: dict, damping: float):
    """(feature, bound, sums below, sums above) of the split that gains most, the first of equals; None if none gains."""
    best, damp = None, damping * UNIT
    for i, f in enumerate(features):
        own = sorted((c["bin"], c["g"], c["h"]) for c in cells if c["feature"] == i)
        all_g, all_h = sum(c[1] for c in own), sum(c[2] for c in own)
        g = h = 0
        for bin_, dg, dh in own[:-1]:
            g, h = g + dg, h + dh
            if min(h, all_h - h) < UNIT:
                continue
            gain = g * g / (h + damp) + (all_g - g) ** 2 / (all_h - h + damp) - all_g**2 / (all_h + damp)
            if gain > 1e-3 * UNIT and (best is None or gain > best[0]):
                best = (gain, f, bounds[f][bin_], (g, h), (all_g - g, all_h - h))
    return best and best[1:]

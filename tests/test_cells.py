"""Neighbours by cells against all pairs."""

import math
import random

import pytest

from quillon.functions.distances import distance
from quillon.operators.classify import Knn, Shape
from quillon.operators.folds import Holdout, KFold, LeaveOneOut
from quillon.sources.labelled import from_columns

MINKOWSKI = {"type": "minkowski", "params": {"p": 3}}


def clustered(spark, n, width, groups, seed, more=()):
    rng = random.Random(seed)
    centres = [[rng.uniform(-100, 100) for _ in range(width)] for _ in range(groups)]
    rows = [[round(c + rng.gauss(0, 0.5), 2) for c in centres[i % groups if i % 3 else 0]] for i in range(n)]
    rows += [list(rows[i]) for i in range(0, n, 5)] + [list(r) for r in more]  # ties in plenty
    names = [f"x{i}" for i in range(width)]
    schema = ", ".join(["i long", *(f"{c} double" for c in names), "y string"])
    return from_columns(spark.createDataFrame([(i, *r, "ab"[i % 2]) for i, r in enumerate(rows)], schema), "y", "i")


def neighbours(data, how, what):
    assigned = how.assign(data)
    shape = Shape(data.width, data.n, data.n, 5, tuple(data.classes))
    found = what.neighbours(assigned, assigned.where("fold_id >= 0"), shape).select("fold", "row_idx", "nth", "r_idx", "label", "d")
    return sorted(((*r[:5], "nan" if math.isnan(r[5]) else r[5]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("metric, how", [("euclidean", KFold(4)), ("euclidean", LeaveOneOut()), ("euclidean", Holdout(0.3)), ("manhattan", LeaveOneOut()), ("chebyshev", KFold(4)), (MINKOWSKI, Holdout(0.3))])
def test_same_as_all_pairs(spark, metric, how):
    data = clustered(spark, 150, 3, 6, 1)
    gap = distance(metric)
    assert neighbours(data, how, Knn(4, gap, prune=True)) == neighbours(data, how, Knn(4, gap, prune=False))


@pytest.mark.parametrize("k", [1, 7, 40])
def test_rows_that_are_not_finite(spark, k):
    nan, inf = math.nan, math.inf
    odd = [(nan, 0.0), (nan, nan), (inf, 1.0), (-inf, inf), (1e200, 1e200), (-1e308, 1e308)]
    for n in (12, 60):
        data = clustered(spark, n, 2, 3, k, odd)
        if k < data.n:
            assert neighbours(data, LeaveOneOut(), Knn(k, prune=True)) == neighbours(data, LeaveOneOut(), Knn(k, prune=False))


def test_large_cells_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr("quillon.operators.classify.BLOCK_BYTES", 1000)
    monkeypatch.setattr("quillon.operators.classify.PART_WORK", 500)
    data = clustered(spark, 200, 2, 4, 3)
    assert neighbours(data, KFold(3), Knn(5, prune=True)) == neighbours(data, KFold(3), Knn(5, prune=False))


def test_few_pairs_meet(spark):
    """On clustered vectors most pairs are ruled out; one group holds over a third of the rows."""
    data = clustered(spark, 4000, 8, 30, 4)
    assigned = LeaveOneOut().assign(data)
    share = Knn(5).pairs_met(assigned, assigned, Shape(data.width, data.n, data.n, data.n, tuple(data.classes)))
    print(f"pairs met: {share:.3f} of all")
    assert share < 0.2


def test_pruning_is_chosen_where_it_pays(spark, monkeypatch):
    monkeypatch.setattr("quillon.operators.classify.PRUNED_WORK", 1)
    monkeypatch.setattr("quillon.operators.classify.SAMPLE", 64)
    chosen = []
    plain = Knn._all
    monkeypatch.setattr(Knn, "_all", lambda *a: chosen.append(1) or plain(*a))
    data = clustered(spark, 600, 4, 20, 5)
    pruned = neighbours(data, KFold(3), Knn(3))
    assert not chosen and pruned == neighbours(data, KFold(3), Knn(3, prune=False)) and chosen
    # Not a metric, or nothing to rule out: all pairs.
    del chosen[:]
    neighbours(data, KFold(3), Knn(3, distance({"type": "minkowski", "params": {"p": 0.5}})))
    rng = random.Random(6)
    flat = from_columns(spark.createDataFrame([(i, *[rng.gauss(0, 1) for _ in range(24)], "a") for i in range(300)], ", ".join(["i long", *(f"x{j} double" for j in range(24)), "y string"])), "y", "i")
    neighbours(flat, KFold(3), Knn(3))
    assert len(chosen) == 2

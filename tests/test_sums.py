"""Sums to the last bit, however rows are dealt."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.sums import digits
from quillon.operators.classify import NearestCentroid, Shape
from quillon.operators.folds import KFold
from quillon.sources.labelled import from_columns


def summed(rows):
    made = digits(rows, [F.col("x")])[0]
    each = rows.agg(*[F.sum(d).alias(f"s{j}") for j, d in enumerate(made.of(F.col("x")))])
    return each.select(made.whole([F.col(f"s{j}") for j in range(made.size)]).alias("s")).first()["s"]


@pytest.mark.parametrize("low, high", [(-3, 3), (-20, 20), (290, 307), (-320, -300), (0, 0)])
def test_sums(spark, low, high):
    rng = random.Random(low)
    numbers = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.uniform(low, high) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    found = {summed(rows.repartition(n)) for n in (1, 7, 211)} | {summed(rows.orderBy("x"))}
    assert len(found) == 1
    biggest = max(map(abs, numbers))
    assert found.pop() == pytest.approx(math.fsum(numbers), rel=1e-15, abs=3000 * max(biggest * 2.0**-88, 2.0**-960))


@pytest.mark.parametrize("numbers, want", [([], None), ([0.0, -0.0], 0.0), ([1e308, 1.0, -1e308], 0.0), ([1e16, 1.0, -1e16], 1.0), ([1.0, math.inf], math.inf), ([math.inf, -math.inf], math.nan), ([1.0, math.nan], math.nan), ([-math.inf, 2.0], -math.inf), ([0.1] * 10, 1.0), ([5e-324], 0.0)])
def test_edges(spark, numbers, want):
    found = summed(spark.createDataFrame([(x,) for x in numbers], "x double"))
    assert found == want or (want is not None and math.isnan(want) and math.isnan(found))


def test_centroids_to_the_last_bit(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1e6), rng.random() * 1e-3, rng.choice([math.nan, 1.0]) if i % 500 == 0 else rng.random(), "abc"[i % 3]) for i in range(2000)]
    found = []
    for n in (1, 7, 211):
        data = from_columns(spark.createDataFrame(rows, "i long, x double, y double, z double, c string").repartition(n), "c", "i")
        for folds in (1, 5):
            assigned = KFold(5).assign(data) if folds == 5 else data.frame.withColumn("fold_id", F.lit(-1).cast("long"))
            model = NearestCentroid().fit(assigned.repartition(n), Shape(3, data.n, data.n, folds, tuple(data.classes)))
            found.append((folds, repr(sorted((r["fold"], r["label_s"], r["n"], tuple(r["centroid"])) for r in model.collect()))))
    assert len(set(found)) == 2
    exact = [math.fsum(r[1] for r in rows if r[4] == c) / sum(r[4] == c for r in rows) for c in "abc"]
    model = NearestCentroid().fit(data.frame.withColumn("fold_id", F.lit(-1).cast("long")), Shape(3, data.n, data.n, 1, tuple(data.classes)))
    assert [r["centroid"][0] for r in model.orderBy("label_s").collect()] == pytest.approx(exact, rel=1e-15)


def test_wide_and_narrow_sums_are_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, *[rng.gauss(0, 10.0**j) for j in range(4)], math.inf if i == 7 else 1.0, "ab"[i % 2]) for i in range(300)]
    data = from_columns(spark.createDataFrame(rows, "i long, v double, w double, x double, y double, z double, c string"), "c", "i")
    found = []
    for most in (16, 2):
        monkeypatch.setattr("quillon.operators.classify.WIDE", most)
        models = []
        for folds, assigned in ((1, data.frame.withColumn("fold_id", F.lit(-1).cast("long"))), (3, KFold(3).assign(data))):
            model = NearestCentroid().fit(assigned, Shape(5, data.n, data.n, folds, tuple(data.classes)))
            models.append(sorted((r["fold"], r["label_s"], r["label"], r["n"], tuple(r["centroid"])) for r in model.collect()))
        found.append(repr(models))
    assert found[0] == found[1]

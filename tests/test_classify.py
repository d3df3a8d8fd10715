import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.errors import ClassifierError, DataError
from quillon.functions.distances import distance
from quillon.operators.classify import Knn, NearestCentroid
from quillon.operators.folds import KFold, LeaveOneOut
from quillon.operators.nearest import least
from quillon.plans.experiment import between, predictions
from quillon.sources.labelled import from_columns


def points(spark, rows):
    """rows: (features..., label)."""
    width = len(rows[0]) - 1
    names = [f"x{i}" for i in range(width)]
    schema = ", ".join(["i long", *(f"{n} double" for n in names), "y string"])
    return from_columns(spark.createDataFrame([(i, *map(float, r[:-1]), r[-1]) for i, r in enumerate(rows)], schema), "y", "i")


def told(found):
    return {r["row_idx"]: r["pred_s"] for r in found.collect()}


@pytest.mark.parametrize(
    "metric, want",
    [("euclidean", 5.0), ("manhattan", 7.0), ("cityblock", 7.0), ("chebyshev", 4.0), ("chessboard", 4.0), ({"type": "minkowski", "params": {"p": 3}}, 91 ** (1 / 3))],
)
@pytest.mark.parametrize("unrolled", [True, False])
def test_distances(spark, monkeypatch, metric, want, unrolled):
    if not unrolled:
        monkeypatch.setattr("quillon.functions.distances.UNROLLED", 0)
    gap = distance(metric).between(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(3.0), F.lit(-3.0)), 2)
    assert spark.range(1).select(gap).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("metric", ["cosine", {"type": "minkowski"}, {"type": "minkowski", "params": {"p": 0}}, {"type": "minkowski", "params": {"p": math.inf}}, 3])
def test_distances_refused(metric):
    with pytest.raises(ClassifierError):
        distance(metric)


@pytest.mark.parametrize(
    "train, want",
    [
        ([(1, "A"), (2, "A"), (1.5, "B")], "A"),
        ([(1, "A"), (2, "A"), (1, "B"), (1.5, "B")], "B"),
        ([(1, "A"), (2, "A"), (-1, "B"), (-2, "B")], "A"),
        ([(1, "2"), (-1, "10")], "10"),
    ],
)
def test_votes(spark, train, want):
    found = between(points(spark, train), points(spark, [(0, "A")]), Knn(len(train)))
    assert told(found) == {0: want}


def test_nearest_by_row_number(spark):
    found = between(points(spark, [(1, "B"), (-1, "A"), (1, "A")]), points(spark, [(0, "A")]), Knn(1))
    assert told(found) == {0: "B"}


def brute(rows, folds, k):
    x, y = np.array([r[:-1] for r in rows], float), [r[-1] for r in rows]
    out = {}
    for i in range(len(rows)):
        near = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(len(rows)) if folds[j] != folds[i])[:k]
        groups = {}
        for d, j in near:
            groups.setdefault(y[j], []).append(d)
        out[i] = min(groups, key=lambda c: (-len(groups[c]), sum(groups[c]), c))
    return out


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_knn_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr("quillon.operators.classify.PART_WORK", 800)
    rng = np.random.default_rng(3)
    rows = [(*rng.normal(size=3), str(rng.integers(3))) for _ in range(60)]
    data = points(spark, rows)
    how = KFold(4, stratify=False, shuffle=False)
    assert told(predictions(data, how, Knn(5, blocks=blocks))) == brute(rows, [i % 4 for i in range(60)], 5)


def test_least_with_ties_and_missing_numbers():
    rng = np.random.default_rng(5)
    for _ in range(200):
        m, n, k = rng.integers(1, 6), rng.integers(1, 12), int(rng.integers(1, 8))
        gaps = rng.choice([0.0, 1.0, 2.0, np.inf, np.nan], size=(m, n))
        apart = rng.random((m, n)) < 0.7
        want = [(i, j) for i in range(m) for j in sorted(np.flatnonzero(apart[i]), key=lambda j: (np.isnan(gaps[i, j]), gaps[i, j] if gaps[i, j] == gaps[i, j] else 0, j))[:k]]
        rows, columns = least(gaps, apart, k)
        order = np.argsort(rows, kind="stable")
        assert list(zip(rows[order].tolist(), columns[order].tolist())) == want


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", {"type": "minkowski", "params": {"p": 7}}, {"type": "minkowski", "params": {"p": 1.5}}])
def test_matrix_is_the_column_expression(spark, metric):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(3, 5)), rng.normal(size=(4, 5))
    own = distance(metric)
    rows = spark.createDataFrame([(i, j, x[i].tolist(), y[j].tolist()) for i in range(3) for j in range(4)], "i int, j int, a array<double>, b array<double>")
    found = {(r[0], r[1]): r[2] for r in rows.select("i", "j", own.between(F.col("a"), F.col("b"), 5)).collect()}
    for (i, j), d in found.items():
        assert own.matrix(x, y)[i, j] == pytest.approx(d, rel=1e-12)


def test_leave_one_out_with_large_and_negative_keys(spark):
    for keys in ([5_000_000_000 + i for i in range(6)], [-3, -2, -1, 0, 1, 2]):
        frame = spark.createDataFrame([(k, float(i % 3), "ab"[i % 2]) for i, k in enumerate(keys)], "i long, x double, y string")
        data = from_columns(frame, "y", "i")
        for what in (Knn(1), NearestCentroid()):
            found = predictions(data, LeaveOneOut(), what).collect()
            assert sorted(r["row_idx"] for r in found) == keys and min(r["fold"] for r in found) >= 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_centroid_plans_have_no_cartesian_product(spark, monkeypatch):
    data = points(spark, [(i % 7, i % 5, "abc"[i % 3]) for i in range(60)])
    for found in (between(data, data, NearestCentroid()), predictions(data, KFold(5), NearestCentroid()), predictions(data, LeaveOneOut(), NearestCentroid())):
        assert "CartesianProduct" not in plan(found) and "BroadcastExchange" in plan(found)
    # A model that is too large to broadcast is dealt into blocks, with the same result.
    want = [told(x) for x in (between(data, data, NearestCentroid()), predictions(data, KFold(5), NearestCentroid()), predictions(data, LeaveOneOut(), NearestCentroid()))]
    monkeypatch.setattr("quillon.operators.classify.BROADCAST_BYTES", 0)
    monkeypatch.setattr("quillon.operators.classify._parts", lambda total, most=0: 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = (between(data, data, NearestCentroid()), predictions(data, KFold(5), NearestCentroid()), predictions(data, LeaveOneOut(), NearestCentroid()))
        assert all("CartesianProduct" not in plan(x) and "Broadcast" not in plan(x) for x in dealt)
        assert [told(x) for x in dealt] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_centroids_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(*rng.normal(size=2), str(rng.integers(3))) for _ in range(50)]
    x, y = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows])
    for how, folds in ((KFold(5, stratify=False, shuffle=False), [i % 5 for i in range(50)]), (LeaveOneOut(), list(range(50)))):
        want = {}
        for i in range(50):
            rest = np.array(folds) != folds[i]
            gaps = {c: np.linalg.norm(x[i] - x[rest & (y == c)].mean(axis=0)) for c in sorted(set(y[rest]))}
            want[i] = min(gaps, key=lambda c: (gaps[c], c))
        assert told(predictions(points(spark, rows), how, NearestCentroid())) == want


def test_centroid_that_is_nan_wins(spark):
    train = points(spark, [(0, "a"), (math.nan, "b")])
    assert told(between(train, points(spark, [(0, "a")]), NearestCentroid())) == {0: "b"}


def test_a_class_of_one_drops_out_when_left_out(spark):
    found = predictions(points(spark, [(0, "a"), (1, "a"), (9, "b")]), LeaveOneOut(), NearestCentroid())
    assert told(found)[2] == "a"


def test_refusals(spark):
    data = points(spark, [(0, "a"), (1, "b"), (2, "a")])
    for k in (0, -1, True, 1.5):
        with pytest.raises(ClassifierError):
            Knn(k)
    with pytest.raises(ClassifierError):
        predictions(data, LeaveOneOut(), Knn(3))
    with pytest.raises(DataError):
        between(data, points(spark, [(0, 1, "a")]), Knn(1))

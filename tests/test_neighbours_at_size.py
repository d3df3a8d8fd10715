"""What neighbours of many rows take, and that they are those of all pairs in every way they are found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.distances import distance
from quillon.operators.classify import Knn, Shape
from quillon.operators.folds import Holdout, KFold, LeaveOneOut
from quillon.operators.nearest import least, nearest
from quillon.sources.labelled import from_columns
from tests.test_cells import MINKOWSKI, neighbours

METRICS = ["euclidean", "manhattan", "chebyshev", MINKOWSKI]


def table(spark, rows):
    names = [f"x{i}" for i in range(len(rows[0]))]
    schema = ", ".join(["i long", *(f"{c} double" for c in names), "y string"])
    return from_columns(spark.createDataFrame([(i, *map(float, r), "ab"[i % 2]) for i, r in enumerate(rows)], schema), "y", "i")


def flat(n, width, seed):
    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(width)] for _ in range(n)]


def shuffled_bytes(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("width", [1, 2, 20])
def test_nearest_of_a_block(metric, width):
    gap, rng = distance(metric), np.random.default_rng(width)
    for scale, far in ((1, False), (1000, False), (1000, True)):
        y, x = (np.round(rng.normal(size=(n, width)) * scale) + far * 1e8 for n in (700, 60))
        y[::3] = y[0]  # ties in plenty
        fold, r_fold = rng.integers(0, 3, len(x)), rng.integers(-1, 3, len(y))
        all_ = gap.matrix(x, y)
        i, j = least(all_, fold[:, None] != r_fold[None, :], 5)
        assert sorted(zip(*nearest(gap, x, fold, y, r_fold, 5))) == sorted(zip(i, j, all_[i, j]))


@pytest.mark.parametrize("metric", METRICS)
def test_blocks_are_written_once(spark, monkeypatch, metric):
    """However many pairs of blocks there are; training rows were written once for each of 60 chunks."""
    data = table(spark, flat(300, 24, 1))
    gap, written = distance(metric), []
    for work in (10**9, 300 * 300 * 24 // 60):
        monkeypatch.setattr("quillon.operators.classify.PART_WORK", work)
        before = shuffled_bytes(spark)
        found = neighbours(data, KFold(3), Knn(2, gap, prune=False))
        written.append((shuffled_bytes(spark) - before, found))
    assert written[0][1] == written[1][1]
    assert written[1][0] < 3 * written[0][0]


def test_cells_that_rule_nothing_out(spark, monkeypatch):
    """Of many pairs, of which cells would leave nearly all, every test row would be written for every cell."""
    monkeypatch.setattr("quillon.operators.classify.PRUNED_WORK", 1)
    monkeypatch.setattr("quillon.operators.classify.SAMPLE", 64)
    chosen, plain = [], Knn._all
    monkeypatch.setattr(Knn, "_all", lambda *a: chosen.append(1) or plain(*a))
    data = table(spark, flat(300, 24, 2))
    found = neighbours(data, KFold(3), Knn(3, prune=True))
    assert chosen
    assert found == neighbours(data, KFold(3), Knn(3, prune=False))


def test_few_pairs_that_cells_would_write_many_times(spark, monkeypatch):
    """Below PRUNED_WORK every test row went to every cell: 8,000 vectors of 64 coordinates to 89 of them."""
    monkeypatch.setattr("quillon.operators.classify.SPREAD_BYTES", 1)
    monkeypatch.setattr("quillon.operators.classify.SAMPLE", 64)
    data, how = table(spark, flat(300, 24, 5)), KFold(3)
    before = shuffled_bytes(spark)
    want = neighbours(data, how, Knn(3, prune=False))
    between = shuffled_bytes(spark)
    chosen, plain = [], Knn._all
    monkeypatch.setattr(Knn, "_all", lambda *a: chosen.append(1) or plain(*a))
    assert neighbours(data, how, Knn(3, prune=True)) == want and chosen
    assert shuffled_bytes(spark) - between < 6 * (between - before)


@pytest.mark.parametrize("how", [KFold(4), LeaveOneOut(), Holdout(0.3)])
@pytest.mark.parametrize("prune", [True, False])
def test_equal_rows_are_looked_for_once(spark, monkeypatch, how, prune):
    data = table(spark, [[i % 5, i % 2] for i in range(400)] + flat(20, 2, 3))
    want = neighbours(data, how, Knn(3, prune=prune))
    monkeypatch.setattr("quillon.operators.classify.COPIES_WORK", 1)
    assert neighbours(data, how, Knn(3, prune=prune)) == want
    assigned = how.assign(data)
    t, r = Knn._sides(assigned, assigned.where("fold_id >= 0"))
    _, _, _, shape = Knn(3)._once(t, r, Shape(2, data.n, data.n, 5, tuple(data.classes)))
    # 30 different vectors: at most 2 k training rows of each, each asked for in at most as many folds and in none.
    assert shape.n_train <= 30 * 6 and shape.n_test <= 30 * 7


def test_votes_of_equal_rows(spark, monkeypatch):
    from quillon.plans.experiment import predictions

    data = table(spark, [[i % 7] for i in range(300)])
    want = sorted(map(repr, predictions(data, KFold(5), Knn(4)).collect()))
    monkeypatch.setattr("quillon.operators.classify.COPIES_WORK", 1)
    assert sorted(map(repr, predictions(data, KFold(5), Knn(4)).collect())) == want


def test_many_ranks_are_not_broadcast(spark, monkeypatch):
    """Files of repeated values are small, their rows are not: Spark would send them to the driver."""
    monkeypatch.setattr("quillon.sources.shared.BROADCAST_ROWS", 100)
    assigned = KFold(5).assign(table(spark, [[i % 7] for i in range(300)]))
    assigned.collect()
    assert "BroadcastHashJoin" not in assigned._jdf.queryExecution().executedPlan().toString()


def test_cells_take_few_rows_at_a_time(spark, monkeypatch):
    """Distances to pivots, of which a batch of rows with hundreds of pivots took 200 MB a worker."""
    from quillon.operators import cells

    monkeypatch.setattr(cells, "HELD", 64)
    data = table(spark, flat(200, 2, 4))
    found = neighbours(data, KFold(3), Knn(3, prune=True))
    assert found == neighbours(data, KFold(3), Knn(3, prune=False))


@pytest.mark.parametrize("how", [KFold(3), Holdout(0.3)])
def test_one_coordinate_takes_no_cells(spark, monkeypatch, how):
    """Cells made distances to 256 pivots of each row, five times, and met twice; the order of the coordinate takes a pass."""
    data = table(spark, flat(300, 1, 6) + [[float("nan")], [float("inf")], [1e200], [-1e200]])
    want = neighbours(data, how, Knn(3, prune=True))
    monkeypatch.setattr("quillon.operators.classify.PRUNED_WORK", 1)
    monkeypatch.setattr("quillon.operators.classify.COPIES_WORK", 1)
    monkeypatch.setattr("quillon.operators.cells.pivots", None)
    assert repr(neighbours(data, how, Knn(3))) == repr(want)


def test_a_row_that_is_not_finite_does_not_make_all_pairs(monkeypatch):
    gap, rng = distance("euclidean"), np.random.default_rng(7)
    x, y = rng.normal(size=(400, 1)), rng.normal(size=(4000, 1))
    y[[5, 900]] = [[np.nan], [np.inf]]
    fold, r_fold = np.zeros(400, np.int64), np.full(4000, -1)
    all_ = gap.matrix(x, y)
    i, j = least(all_, np.ones(all_.shape, bool), 3)
    made, plain = [], type(gap).matrix
    monkeypatch.setattr(type(gap), "matrix", lambda self, a, b: made.append(len(a) * len(b)) or plain(self, a, b))
    assert sorted(zip(*nearest(gap, x, fold, y, r_fold, 3))) == sorted(zip(i, j, all_[i, j]))
    assert sum(made) == 0
    # Those with fewer than k finite ones meet the others too.
    few = np.array([[1.0], [np.nan], [np.inf], [2.0]])
    d = gap.matrix(x, few)
    i, j = least(d, np.ones(d.shape, bool), 3)
    assert repr(sorted(zip(*nearest(gap, x, fold, few, r_fold[:4], 3)))) == repr(sorted(zip(i, j, d[i, j])))


@pytest.mark.parametrize("how, rows", [(LeaveOneOut(), [[i % 300, 0.0 if i % 2 else -0.0] for i in range(390)] + [[float("nan"), 1]] * 10), (KFold(4), [[7, 7]] * 300 + [[i, 1] for i in range(100)])])
def test_sorted_partitions_are_bounded_whatever_they_take_compressed(spark, monkeypatch, how, rows):
    """Spark joined partitions of few bytes, compressed, and chose joins by the size of files: one task sorted all of these rows."""
    data = table(spark, rows)
    want = neighbours(data, how, Knn(3, prune=True))
    for name, value in (("COPIES_WORK", 1), ("BROADCAST_ROWS", 1), ("HEAVY", 40), ("SORTED_BYTES", 64 * 256)):
        monkeypatch.setattr(f"quillon.operators.classify.{name}", value)
    monkeypatch.setattr("quillon.sources.shared.BROADCAST_ROWS", 1)
    # More partitions than are asked for, which Spark joins.
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert neighbours(data, how, Knn(3, prune=True)) == want
        assigned = how.assign(data)
        shape = Shape(data.width, data.n, data.n, 5, tuple(data.classes))
        found = Knn(3, prune=False).neighbours(assigned, assigned.where("fold_id >= 0"), shape)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400 * 3 and max(sizes) < 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def made_by(monkeypatch, gap, *sides):
    """What nearest() finds, and the distances that it makes."""
    made = []
    with monkeypatch.context() as m:
        for name, size in (("matrix", lambda a, b: len(a) * len(b)), ("pairs", lambda x, i, y, j: i.size)):
            plain = getattr(type(gap), name)
            m.setattr(type(gap), name, lambda self, *a, plain=plain, size=size: made.append(size(*a)) or plain(self, *a))
        return sorted(zip(*nearest(gap, *sides))), sum(made)


def few_distances(monkeypatch, metric):
    """Distances of all pairs were made coordinate by coordinate, which took over four times as long as those of L2."""
    gap, rng = distance(metric), np.random.default_rng(8)
    x, y = rng.normal(size=(400, 32)), rng.normal(size=(6000, 32))
    fold, r_fold = rng.integers(0, 3, len(x)), rng.integers(-1, 3, len(y))
    all_ = gap.matrix(x, y)
    i, j = least(all_, fold[:, None] != r_fold[None, :], 3)
    found, made = made_by(monkeypatch, gap, x, fold, y, r_fold, 3)
    assert found == sorted(zip(i, j, all_[i, j]))
    assert made < 0.1 * all_.size


def odd_rows(monkeypatch, metric):
    """What rounding, overflow or ties may do to a bound leaves neighbours as they are."""
    gap, rng = distance(metric), np.random.default_rng(9)
    plain = rng.normal(size=(900, 24))
    odd = [plain + 1e8, plain * 1e-160, plain * 1e-30, plain * 1e30, plain * 1e200, np.round(plain), np.round(plain * 3) + 1e12, plain * 0 + 5, np.sign(plain) * np.exp(8 * np.abs(plain))]
    odd += [plain * (10.0 ** rng.integers(-9, 9, size=24)), np.repeat(plain[:30], 30, axis=0) + 1e-9 * plain, np.concatenate([plain, [[1e14] * 24]])]
    for rows in odd:
        for n in (900, 5):
            x, y = rows[::9], rows[-n:]
            fold, r_fold = rng.integers(0, 3, len(x)), rng.integers(-1, 3, len(y))
            with np.errstate(over="ignore"):
                all_ = gap.matrix(x, y)
            i, j = least(all_, fold[:, None] != r_fold[None, :], 4)
            assert made_by(monkeypatch, gap, x, fold, y, r_fold, 4)[0] == sorted(zip(i, j, all_[i, j]))


def test_minkowski_makes_few_distances(monkeypatch):
    few_distances(monkeypatch, MINKOWSKI)


@pytest.mark.parametrize("p", [1, 1.5, 2, 2.5, 3, 7, 64, 300])
def test_minkowski_of_odd_rows(monkeypatch, p):
    odd_rows(monkeypatch, {"type": "minkowski", "params": {"p": p}})


def test_largest_difference_makes_few_distances(monkeypatch):
    few_distances(monkeypatch, "chebyshev")
    odd_rows(monkeypatch, "chebyshev")


def test_manhattan_makes_few_distances(monkeypatch):
    few_distances(monkeypatch, "manhattan")
    odd_rows(monkeypatch, "manhattan")


def test_pairs_of_blocks_are_bounded(spark, monkeypatch):
    """600,000 vectors made 4,600 pairs, each of which read 32 MB for 1,300 test rows."""
    data = table(spark, flat(120, 6, 10))
    want = neighbours(data, KFold(3), Knn(2, blocks=2))
    monkeypatch.setattr("quillon.operators.classify.PART_WORK", 120 * 120 * 6 // 40)
    monkeypatch.setattr("quillon.operators.classify.PAIRS", 6)
    assigned = KFold(3).assign(data)
    t, r = Knn._sides(assigned, assigned)
    assert Knn(2, blocks=2)._all(t, r, Shape(6, 120, 120, 3, tuple(data.classes))).rdd.getNumPartitions() <= 6
    assert neighbours(data, KFold(3), Knn(2, blocks=2)) == want

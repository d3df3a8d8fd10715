import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillon.errors import DataError, ValidationError
from quillon.operators.folds import Holdout, KFold, LeaveOneOut, fold_stats, partitions, quotas
from quillon.sources.labelled import from_columns


def labelled(spark, labels):
    rows = [(i, float(i), y) for i, y in enumerate(labels)]
    return from_columns(spark.createDataFrame(rows, "i long, x double, y string"), "y", "i")


def folds_of(df):
    return {r["row_idx"]: r["fold_id"] for r in df.collect()}


@pytest.mark.parametrize(
    "counts, size, want",
    [([20, 8], 0.2, [4, 2]), ([20, 8], 0.25, [5, 2]), ([14, 13], 0.2, [2, 3]), ([1, 9], 0.3, [0, 3])],
)
def test_quotas(counts, size, want):
    assert quotas(counts, size) == want


def test_quotas_that_cannot_be_had():
    with pytest.raises(ValidationError):
        quotas([2] * 5, 0.2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8), st.floats(0.05, 0.95))
def test_quotas_are_exact(counts, size):
    n = sum(counts)
    if n < 2:
        return
    try:
        take = quotas(counts, size)
    except ValidationError:
        return
    assert sum(take) == min(max(round(n * size), 1), n - 1)
    assert all(0 <= k <= max(0, m - 1) for k, m in zip(take, counts))


@pytest.mark.parametrize("rows", [10**6, 0])
def test_kfold_sizes(spark, monkeypatch, rows):
    monkeypatch.setattr("quillon.operators.folds.WINDOW_ROWS", rows)  # ranks by one window, or by a sort over all tasks
    data = labelled(spark, ["1"] * 20 + ["2"] * 8)
    for shuffle in (False, True):
        found = KFold(5, shuffle=shuffle).assign(data)
        sizes = [r[1] for r in sorted(found.groupBy("fold_id").count().collect())]
        assert sizes == [6, 6, 6, 5, 5]
        stats = {(r["fold_id"], r["label_s"]): r["n_test"] for r in fold_stats(found, data.classes).collect()}
        assert [stats[f, "1"] for f in range(5)] == [4] * 5
        assert [stats[f, "2"] for f in range(5)] == [2, 2, 2, 1, 1]
    plain = KFold(5, stratify=False).assign(data)
    assert [r[1] for r in sorted(plain.groupBy("fold_id").count().collect())] == [6, 6, 6, 5, 5]


def test_every_row_tests_once(spark):
    data = labelled(spark, ["a", "b", "c"] * 9)
    for how in (KFold(4), KFold(4, stratify=False), LeaveOneOut()):
        found = folds_of(how.assign(data))
        assert sorted(found) == list(range(27)) and min(found.values()) == 0
    assert len(set(folds_of(LeaveOneOut().assign(data)).values())) == 27


def test_holdout(spark):
    data = labelled(spark, ["1"] * 20 + ["2"] * 8)
    found = Holdout(0.2).assign(data)
    assert {r[0]: r[1] for r in found.where("fold_id = 0").groupBy("label_s").count().collect()} == {"1": 4, "2": 2}
    assert Holdout(0.5, stratify=False).assign(labelled(spark, ["a"] * 25)).where("fold_id = 0").count() == 12


def test_numpy_order(spark):
    import numpy as np

    data = labelled(spark, ["b"] * 6 + ["a"] * 5)
    found = folds_of(KFold(3, seed=1, order="numpy").assign(data))
    rng, want = np.random.default_rng(1), {}
    for own in ([6, 7, 8, 9, 10], [0, 1, 2, 3, 4, 5]):  # classes in natural order
        for rank, j in enumerate(rng.permutation(len(own))):
            want[own[j]] = rank % 3
    assert found == want


def test_guards(spark):
    two, one = labelled(spark, ["a", "b", "a", "b"]), labelled(spark, ["a"])
    for how, data in ((Holdout(0.0), two), (Holdout(1.0), two), (KFold(1), two), (KFold(5), two), (LeaveOneOut(), one), (KFold(2), one), (Holdout(), one)):
        with pytest.raises(ValidationError):
            how.assign(data)


def test_partitions(spark):
    data = labelled(spark, ["a", "b"] * 4)
    rows = partitions(KFold(2).assign(data), 2).groupBy("fold", "role").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == [(0, "test", 4), (0, "train", 4), (1, "test", 4), (1, "train", 4)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_shuffled_rows_are_all_numbered(spark, monkeypatch, adaptive):
    """A frame whose partitions Spark may deal anew each time it is evaluated."""
    monkeypatch.setattr("quillon.operators.folds.WINDOW_ROWS", 0)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        n, wide = 200_000, [(F.col("id") * i % 1000 / 7).alias(f"x{i}") for i in range(20)]
        rows = spark.range(n).select((F.col("id") % 7919).alias("k"), *wide, F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("y"))
        met = rows.repartition("k").join(spark.range(7919).withColumnRenamed("id", "k"), "k").drop("k")
        data = from_columns(met, "y")
        assert data.n == n
        for frame in (data.frame, data.frame.select("row_idx", "label_s")):
            assert tuple(frame.agg(F.count("row_idx"), F.countDistinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()) == (n, n, 0, n - 1)
        assert KFold(5).assign(data).groupBy("fold_id").count().where(f"count <> {n // 5}").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_files_number_their_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("y")).repartition(3).write.parquet(path)
    data = from_columns(spark.read.parquet(path), "y")
    found = data.frame.agg(F.count("row_idx"), F.countDistinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()
    assert tuple(found) == (1000, 1000, 0, 999)
    some = from_columns(spark.read.parquet(path).where("x < 10"), "y")  # not all rows of the files: these are written
    assert sorted(r[0] for r in some.frame.select("row_idx").collect()) == list(range(10))


@pytest.mark.parametrize("rows", [10**6, 0])
def test_repeated_and_missing_keys(spark, monkeypatch, rows):
    monkeypatch.setattr("quillon.operators.folds.WINDOW_ROWS", rows)
    frame = spark.createDataFrame([(1, 0.0, "a"), (1, 1.0, "b"), (2, 2.0, "a"), (3, 3.0, "b")], "i long, x double, y string")
    with pytest.raises(Exception, match="repeat the key 1"):
        KFold(2).assign(from_columns(frame, "y", "i")).collect()
    with pytest.raises(DataError):
        from_columns(frame.withColumn("i", F.when(F.col("i") > 1, F.col("i"))), "y", "i")

"""Classes and labels too many for the driver: tables in their place, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.errors import DataError, ValidationError
from quillon.operators import evaluate
from quillon.operators.classify import Knn, NearestCentroid
from quillon.operators.folds import Holdout, KFold, quota_table, quotas
from quillon.plans import experiment
from quillon.sources.labelled import from_columns


@pytest.fixture
def tabled(monkeypatch):
    """Any class is one too many for the driver."""
    monkeypatch.setattr("quillon.sources.labelled.CLASSES", 0)


def classes(spark, counts):
    rows = [(c, i) for c, n in enumerate(counts) for i in range(n)]
    return from_columns(spark.createDataFrame([(j, float(i), c) for j, (c, i) in enumerate(rows)], "i long, x double, y int"), "y", "i")


@pytest.mark.parametrize("size", [0.2, 0.25, 0.5, 0.77, 0.9])
def test_quotas_in_closed_form(spark, size):
    rng = random.Random(int(size * 100))
    for counts in ([3, 3, 3, 3], [2, 5, 40], [1, 1, 7, 2], [rng.randrange(1, 9) for _ in range(30)], [6] * 11, [1] * 9 + [30], [2] * 5):
        data = classes(spark, counts)
        try:
            want = dict(enumerate(quotas(counts, size)))
        except ValidationError:
            with pytest.raises(ValidationError):
                quota_table(data, size)
            continue
        assert {int(r["label_s"]): r["k"] for r in quota_table(data, size).collect()} == want


@pytest.mark.parametrize("how", [Holdout(0.3, 5), KFold(3), KFold(3, shuffle=False)])
def test_folds_are_the_same(spark, monkeypatch, how):
    counts = [4, 9, 3, 17, 5, 5, 8]
    listed = classes(spark, counts)
    want, sizes = {r["row_idx"]: r["fold_id"] for r in how.assign(listed).collect()}, how.sizes(listed)
    monkeypatch.setattr("quillon.sources.labelled.CLASSES", 3)
    monkeypatch.setattr("quillon.operators.folds.MAPPED", 3)
    for most in (1_000_000, 10):  # one window, or ranks from a sort by ranges
        monkeypatch.setattr("quillon.operators.folds.WINDOW_ROWS", most)
        data = classes(spark, counts)
        assert data.class_table is not None and (data.n, data.n_classes, data.largest) == (51, 7, 17)
        assert {r["row_idx"]: r["fold_id"] for r in how.assign(data).collect()} == want and how.sizes(data) == sizes
        with pytest.raises(DataError):
            data.classes


def test_predictions_are_the_same(spark, monkeypatch):
    counts = [4, 9, 3, 17, 5]
    found = []
    for most in (100, 2):
        monkeypatch.setattr("quillon.sources.labelled.CLASSES", most)
        data = classes(spark, counts)
        found.append([sorted(map(tuple, experiment.predictions(data, KFold(3), what).collect())) for what in (NearestCentroid(), Knn(3))])
    assert found[0] == found[1]


def test_a_hundred_thousand_classes(spark):
    table = spark.range(300_000).select("id", (F.col("id") % 100_000).alias("y"), (F.col("id") * 0.5).alias("x"))
    data = from_columns(table, "y", "id")
    assert data.n_classes == 100_000 and data.class_table is not None
    folds = Holdout(1 / 3).assign(data).groupBy("label_s").agg(F.sum((F.col("fold_id") == 0).cast("int")).alias("k"))
    assert {r["k"]: r["n"] for r in folds.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 100_000}
    assert sum(KFold(2).sizes(data)) == 300_000


def test_a_million_labels(spark):
    """Cells that occur and totals of labels; no square of the labels anywhere."""
    n = 1_000_000
    labels = spark.range(n).select(F.col("id").cast("string").alias("label_s"))
    found = spark.range(300_000).select(F.col("id").cast("string").alias("true_s"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 1).cast("string").alias("pred_s"))
    cm = evaluate.occurring(found, labels)
    one = evaluate.summary(cm, n).first()
    # A third is right; each of these is predicted by the one before it too.
    assert one["accuracy"] == pytest.approx(1 / 3)
    assert one["macro_recall"] == pytest.approx(100_000 / n)
    assert one["macro_precision"] == pytest.approx((1 + 99_999 / 2) / n)
    assert one["macro_specificity"] == pytest.approx(1.0, abs=1e-5)
    each = evaluate.per_class(cm, labels)
    assert each.count() == n and each.where("tp = 0 AND fp = 0 AND fn = 0 AND specificity = 1").count() == n - 300_001


def test_sparse_is_dense(spark):
    rng = random.Random(4)
    labels = [f"l{i}" for i in range(12)]
    pairs = [(rng.choice(labels[:9] + ["other"]), rng.choice(labels[:8])) for _ in range(400)]
    found = spark.createDataFrame(pairs, "true_s string, pred_s string")
    dense, sparse = evaluate.confusion(found, labels), evaluate.occurring(found, labels)
    assert sorted(map(tuple, sparse.collect())) == sorted(map(tuple, dense.where("n > 0").collect()))
    assert sorted(map(tuple, evaluate.per_class(sparse, labels).collect())) == sorted(map(tuple, evaluate.per_class(dense).collect()))
    assert evaluate.summary(sparse, 12).first().asDict() == pytest.approx(evaluate.summary(dense).first().asDict(), rel=1e-12)


def test_empty(spark):
    none = spark.createDataFrame([], "true_s string, pred_s string")
    one = evaluate.summary(evaluate.occurring(none, ["a", "b"]), 2).first()
    assert (one["accuracy"], one["macro_f1"], one["macro_specificity"], one["mcc"]) == (0, 0, 0, 0)
    assert [r["specificity"] for r in evaluate.per_class(evaluate.occurring(none, ["a"]), ["a"]).collect()] == [0]


def test_verbs_with_many_labels(spark, tmp_path, monkeypatch, tabled):
    import json

    monkeypatch.setattr("quillon.operators.evaluate.LABELS", 3)
    path = tmp_path / "many.csv"
    path.write_text("x,class\n" + "\n".join(f"{i},{i % 7}" for i in range(56)))
    base = {"io": {"dataset": str(path)}, "classifier": {"type": "euclidiano"}}
    place = experiment.run(spark, base | {"validation": {"type": "kfold", "params": {"n_splits": 4}}}, str(tmp_path))
    metrics, meta = (json.loads((place / f"{n}.json").read_text()) for n in ("metrics", "meta"))
    assert metrics["n_labels"] == 7 and meta["dataset"]["n_classes"] == 7
    cells = [x.split(",") for x in (place / "confusion_matrix.csv").read_text().splitlines()]
    assert cells[0] == ["true_label", "pred_label", "n"] and sum(int(c[2]) for c in cells[1:]) == 56
    assert len((place / "metrics_per_class.csv").read_text().splitlines()) == 8
    place = experiment.classify(spark, base | {"mode": {"type": "dataset_split", "split": {"type": "holdout", "params": {"test_size": 0.25}}}}, str(tmp_path))
    assert json.loads((place / "meta.json").read_text())["n_labels"] == 7

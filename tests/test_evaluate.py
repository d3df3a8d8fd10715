import pytest

from quillon.operators import evaluate as ev


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "true_s string, pred_s string")


def pairs_of(matrix, labels):
    return [(a, b) for i, a in enumerate(labels) for j, b in enumerate(labels) for _ in range(matrix[i][j])]


def test_two_classes(spark):
    found = frame(spark, pairs_of([[2, 1], [0, 3]], ["0", "1"]))
    cm = ev.confusion(found, ["0", "1"])
    m = ev.metrics(cm, found, ["0", "1"])
    assert m["accuracy"] == pytest.approx(5 / 6) and m["balanced_accuracy"] == pytest.approx(5 / 6)
    assert m["mcc"] == pytest.approx(12 / (16 * 18) ** 0.5)
    zero, one = m["per_class"]["0"], m["per_class"]["1"]
    assert (zero["precision"], zero["recall"], zero["specificity"], zero["f1"]) == pytest.approx((1, 2 / 3, 1, 0.8))
    assert (one["precision"], one["recall"], one["specificity"], one["f1"]) == pytest.approx((0.75, 1, 2 / 3, 6 / 7))
    assert m["support"] == {"0": 3, "1": 3} and m["macro"]["recall"] == m["macro"]["sensitivity"]


def test_class_without_rows_and_labels_left_out(spark):
    found = frame(spark, [("a", "a"), ("b", "z"), ("z", "a")])
    labels = ["a", "b", "c"]
    m = ev.metrics(ev.confusion(found, labels), found, labels)
    assert m["accuracy"] == 1.0 and m["support"] == {"a": 1, "b": 1, "c": 0}
    c = m["per_class"]["c"]
    assert (c["precision"], c["recall"], c["f1"], c["specificity"]) == (0, 0, 0, 1)
    assert m["macro"]["recall"] == pytest.approx(1 / 3)


def test_one_prediction_only(spark):
    found = frame(spark, [("a", "a"), ("b", "a")])
    assert ev.overall(ev.confusion(found, ["a", "b"])).first()["mcc"] == 0


def test_shares_and_wide_form(spark):
    found = frame(spark, [("10", "10"), ("10", "2"), ("2", "2")])
    cm = ev.confusion(found, ["10", "2", "3"])
    rows = {(r[0], r[1]): r[2] for r in ev.by_rows(cm).collect()}
    columns = {(r[0], r[1]): r[2] for r in ev.by_columns(cm).collect()}
    assert rows["10", "2"] == 0.5 and rows["3", "3"] == 0 and columns["10", "2"] == 0.5
    table = ev.wide(cm, ["10", "2", "3"])
    assert table.columns == ["label", "pred_10", "pred_2", "pred_3"]
    assert [list(r) for r in table.collect()] == [["true_10", 1, 1, 0], ["true_2", 0, 1, 0], ["true_3", 0, 0, 0]]


def test_no_predictions(spark):
    found = frame(spark, [])
    m = ev.metrics(ev.confusion(found, ["a"]), found, ["a"])
    assert m["accuracy"] == 0 and m["mcc"] == 0


def test_merged_labels(spark):
    a = spark.createDataFrame([("1", 1)], "label_s string, label int")
    b = spark.createDataFrame([("1", 1), ("2", 2)], "label_s string, label int")
    assert sorted(r["label_s"] for r in ev.merged_labels(a, b).collect()) == ["1", "2"]

import json

import pytest
import yaml

from quillon import cli
from quillon.errors import ClassifierError, ConfigError, DataError, ValidationError
from quillon.plans import config, experiment
from quillon.sources.labelled import read_csv

ROWS = [(30 + i % 7, 58 + i % 5, 1 if i % 7 < 5 else 2) for i in range(28)]


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "points.csv"
    path.write_bytes(("1,2,class\r\n" + "\r\n".join(",".join(map(str, r)) for r in ROWS)).encode())
    return str(path)


def wrote(tmp_path, text, name="x.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv(spark, csv_file):
    data = read_csv(spark, csv_file)
    assert data.n == 28 and data.width == 2 and data.feature_names == ["1", "2"]
    assert {t: n for _, t, n in data.class_counts} == {"1": 20, "2": 8}
    rows = data.frame.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(28))
    assert [(*r["features"], r["label"]) for r in rows] == [(float(a), float(b), c) for a, b, c in ROWS]


def test_csv_types(spark, tmp_path):
    path = wrote(tmp_path, "a,a,b,flag,class\n1,2,NA,true,x\n\n3,4,1.5,False,y\n")
    data = read_csv(spark, path)
    assert data.feature_names == ["a", "a.1", "b", "flag"]
    first, second = (r["features"] for r in data.frame.orderBy("row_idx").collect())
    assert first[:2] == [1, 2] and first[2] != first[2] and first[3] == 1 and second == [3, 4, 1.5, 0]


def test_csv_refusals(spark, tmp_path, csv_file):
    for path, more in (
        (str(tmp_path / "none.csv"), {}),
        (wrote(tmp_path, "a,class\n1,x\n", "x.txt"), {}),
        (csv_file, {"target": "nothing"}),
        (csv_file, {"drop_cols": ["nothing"]}),
        (wrote(tmp_path, "a,class\nword,x\n"), {}),
        (wrote(tmp_path, "a,class\n1,x,2\n", "y.csv"), {}),
        (wrote(tmp_path, "a,class\n1,\n2,x\n", "z.csv"), {}),
    ):
        with pytest.raises(DataError):
            read_csv(spark, path, **more)


def test_validate(spark, csv_file, tmp_path):
    place = experiment.validate(spark, {"io": {"dataset": csv_file}, "validation": {"type": "kfold", "params": {"n_splits": 5}, "export": {"csv": True}}}, str(tmp_path))
    meta = json.loads((place / "meta.json").read_text())
    assert [f["test_size"] for f in meta["folds"]] == [6, 6, 6, 5, 5] and meta["n_folds"] == 5 and not meta["folds_truncated"]
    assert meta["folds"][0]["test_class_counts"] == {"1": 4, "2": 2} and meta["dataset"]["class_counts"] == {"1": 20, "2": 8}
    test = (place / "partitions/fold_0/test.csv").read_text().splitlines()
    train = (place / "partitions/fold_0/train.csv").read_text().splitlines()
    assert test[0] == "1,2,class" and len(test) == 7 and len(train) == 23


def test_tables_in_parts(spark, csv_file, tmp_path):
    """Parts in the order of their names hold what a single file holds, each under a header."""
    config = {"io": {"dataset": csv_file}, "classifier": {"type": "euclidiano"}, "validation": {"type": "kfold", "params": {"n_splits": 3}, "export": {"csv": True}}}
    for verb, name in (("run", "fold_predictions.csv"), ("validate", "partitions/fold_1/train.csv")):
        texts = []
        for single in (True, False):
            place = getattr(experiment, verb)(spark, config | {"report": {"single_files": single}}, str(tmp_path / f"{verb}{single}"))
            lines = (place / name).read_text().splitlines()
            texts.append([x for i, x in enumerate(lines) if i == 0 or x != lines[0]])
        assert texts[0] == texts[1] and len(texts[0]) > 2


def test_export_of_leave_one_out_is_bounded(spark, csv_file, tmp_path, monkeypatch):
    monkeypatch.setattr("quillon.sources.sinks.EXPORT_ROWS", 100)
    with pytest.raises(ValidationError):
        experiment.validate(spark, {"io": {"dataset": csv_file}, "validation": {"type": "loo", "export": {"csv": True}}}, str(tmp_path))


def test_written_tables_are_dropped(spark):
    from quillon.sources.shared import drop_durable, durable, passing, written
    from quillon.sources.sinks import Place

    kept = durable(spark.range(3), "one")
    with passing(spark) as keep:
        gone, also = durable(spark.range(4), "two"), keep(durable(spark.range(5), "three"))
    assert not Place(spark, gone._quillon_path).exists() and kept.count() == 3 and also.count() == 5
    drop_durable(spark)
    assert not Place(spark, kept._quillon_path).exists() and not written(spark)


def test_classify_and_run(spark, csv_file, tmp_path):
    base = {"io": {"dataset": csv_file}, "classifier": {"type": "knn", "params": {"k": 3, "distance": "manhattan"}}}
    place = experiment.classify(spark, base | {"mode": {"type": "dataset_split", "split": {"type": "holdout", "params": {"test_size": 0.25}}}}, str(tmp_path))
    lines = (place / "predictions.csv").read_text().splitlines()
    assert lines[0] == "index,y_true,y_pred" and len(lines) == 8
    assert (place / "confusion_matrix.csv").read_text().splitlines()[0] == ",pred_1,pred_2"
    place = experiment.run(spark, base | {"validation": {"type": "loo"}}, str(tmp_path))
    lines = (place / "fold_predictions.csv").read_text().splitlines()
    assert lines[0] == "fold,index,y_true,y_pred" and len(lines) == 29
    meta = json.loads((place / "meta.json").read_text())
    metrics = json.loads((place / "metrics.json").read_text())
    assert meta["n_folds"] == 28 and meta["summary"]["accuracy"] == metrics["accuracy"]
    assert sum(metrics["support"].values()) == 28
    two = {"io": {"train_dataset": csv_file, "test_dataset": csv_file}, "classifier": {"type": "euclidiano"}}
    place = experiment.classify(spark, two, str(tmp_path))
    assert json.loads((place / "meta.json").read_text())["mode"] == "classify_train_test"


def test_refusals(spark, csv_file, tmp_path):
    for verb, bad, error in (
        ("run", {"io": {}}, ConfigError),
        ("run", {"io": {"dataset": csv_file}, "validation": {"type": "bootstrap"}}, ConfigError),
        ("run", {"io": {"dataset": csv_file}, "validation": {"type": "loo"}, "classifier": {"type": "tree"}}, ConfigError),
        ("run", {"io": {"dataset": csv_file}, "validation": {"type": "loo"}, "classifier": {"type": "euclidiano", "params": {"distance": "l1"}}}, ClassifierError),
        ("classify", {"io": {"dataset": csv_file}, "classifier": {"type": "knn"}}, ConfigError),
        ("classify", {"io": {"dataset": csv_file}, "classifier": {"type": "knn"}, "mode": {"type": "dataset_split", "split": {"type": "kfold"}}}, ConfigError),
    ):
        with pytest.raises(error):
            getattr(experiment, verb)(spark, bad, str(tmp_path))


def test_command_line(spark, csv_file, tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump({"run_name": "one", "io": {"dataset": csv_file}, "validation": {"type": "kfold"}, "classifier": {"type": "knn"}}))
    cli.main(["run", "--config", str(path), "--set", "classifier.params.k=5", "--set", "validation.params.n_splits=4", "--outputs-dir", str(tmp_path)], spark)
    assert "OK run" in capsys.readouterr().out
    with pytest.raises(SystemExit) as stopped:
        cli.main(["run", "--config", str(path), "--set", "oops", "--outputs-dir", str(tmp_path)], spark)
    assert stopped.value.code == 2 and "ERROR" in capsys.readouterr().err


@pytest.mark.parametrize(
    "text, value",
    [("true", True), ("False", False), ("null", None), ("none", "none"), ("7", 7), ("007", 7.0), ("1_000", 1000), ("1.5", 1.5), ("[1, a]", [1, "a"]), ("{a: 1}", {"a": 1}), ("yes", "yes"), (" x ", "x")],
)
def test_scalars(text, value):
    found = config.scalar(text)
    assert found == value and type(found) is type(value)


def test_paths():
    found = {"a": 1}
    config.put(found, "a.b.c", 2)
    assert found == {"a": {"b": {"c": 2}}}
    assert config.as_truth("false") is False and config.as_truth("yes") is True

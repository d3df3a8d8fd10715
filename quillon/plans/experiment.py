"""The three kinds of experiment: validate, classify and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import ClassifierError, ConfigError
from quillon.functions.distances import distance
from quillon.operators import evaluate
from quillon.operators.classify import Classifier, Knn, NearestCentroid, check_k, check_widths, shape_of
from quillon.operators.folds import Holdout, KFold, LeaveOneOut, Splitter, fold_stats
from quillon.plans.config import as_truth
from quillon.sources import sinks
from quillon.sources.labelled import CLASSES, Labelled, read_csv
from quillon.sources.sinks import RunDirectory

#: Folds that a validation's report lists.
LISTED = 50
SPLITTERS = {
    "holdout": lambda p: Holdout(float(p.get("test_size", 0.2)), int(p.get("seed", 42)), as_truth(p.get("stratify", True)), str(p.get("order", "hash"))),
    "kfold": lambda p: KFold(int(p.get("n_splits", 5)), int(p.get("seed", 42)), as_truth(p.get("shuffle", True)), as_truth(p.get("stratify", True)), str(p.get("order", "hash"))),
    "loo": lambda p: LeaveOneOut(),
}
SPLITTERS |= {"k-fold": SPLITTERS["kfold"], "k_fold": SPLITTERS["kfold"]}


def _centroid(params: dict) -> Classifier:
    if "distance" in params:
        raise ClassifierError("the centroid classifier always uses L2: it takes no distance")
    return NearestCentroid()


def _knn(params: dict) -> Classifier:
    return Knn(int(params.get("k", 1)), distance(params.get("distance", "euclidean")))


CLASSIFIERS = {"euclidiano": _centroid, "centroid": _centroid, "knn": _knn}


def _made(kinds: dict, spec: dict, what: str):
    kind = spec.get("type")
    if kind not in kinds:
        raise ConfigError(f"{what}.type is {kind!r}; it has to be one of {sorted(kinds)}")
    return kinds[kind](spec.get("params") or {})


def splitter(spec: dict, what: str = "validation") -> Splitter:
    return _made(SPLITTERS, spec, what)


def classifier(spec: dict) -> Classifier:
    return _made(CLASSIFIERS, spec, "classifier")


def dataset(spark: SparkSession, config: dict) -> Labelled:
    source = config.get("io") or {}
    if not source.get("dataset"):
        raise ConfigError("io.dataset, the path of a CSV file, is missing")
    return read_csv(spark, str(source["dataset"]), str(source.get("target_col", "class")), list(source.get("drop_cols") or []))


def predictions(data: Labelled, how: Splitter, what: Classifier) -> DataFrame:
    """Pooled predictions of all folds, in one plan."""
    assigned, sizes = how.assign(data), how.sizes(data)
    alone = isinstance(how, LeaveOneOut)
    shape = shape_of(data, data.n if alone else sum(sizes), data.n if alone else len(sizes))
    if alone and isinstance(what, NearestCentroid):
        return what.predict_loo(assigned, shape)
    check_k(what, [(f, data.n - n) for f, n in enumerate(sizes)])
    return what.predict(assigned, assigned.where("fold_id >= 0"), shape)


def between(train: Labelled, test: Labelled, what: Classifier) -> DataFrame:
    """Predictions of one table's rows from another's."""
    check_widths(train, test)
    shape = shape_of(train, test.n, 1)
    check_k(what, [(0, train.n)])
    fold = [F.lit(x).cast("long").alias("fold_id") for x in (-1, 0)]
    return what.predict(train.frame.select("*", fold[0]), test.frame.select("*", fold[1]), shape)


def validate(spark: SparkSession, config: dict, outputs: str = "outputs") -> RunDirectory:
    name, when = str(config.get("run_name", "validate")), sinks.stamp()
    run = RunDirectory.create(spark, outputs, name, when)
    data = dataset(spark, config)
    spec = config.get("validation") or {}
    how = splitter(spec)
    assigned = how.assign(data).persist()
    classes = data.classes
    stats = fold_stats(assigned, classes)
    n_folds = data.n if isinstance(how, LeaveOneOut) else len(how.sizes(data))
    # Only the folds that are listed come to the driver.
    first = [r[0] for r in assigned.where("fold_id >= 0").select("fold_id").distinct().orderBy("fold_id").limit(LISTED).collect()]
    listed: dict[int, dict] = {f: {} for f in first}
    for r in stats.where(F.col("fold_id").isin(first)).collect():
        listed[r["fold_id"]][r["label_s"]] = (r["n_train"], r["n_test"])
    folds = [
        {
            "fold": f,
            "train_size": sum(own[c][0] for c in classes),
            "test_size": sum(own[c][1] for c in classes),
            "train_class_counts": {c: own[c][0] for c in classes},
            "test_class_counts": {c: own[c][1] for c in classes},
        }
        for f, own in listed.items()
    ]
    exported = as_truth((spec.get("export") or {}).get("csv", False))
    if exported:
        sinks.export_partitions(data, assigned, run / "partitions", n_folds, isinstance(how, LeaveOneOut), _single(config))
    about = _about(config, data) | {"class_counts": {text: n for _, text, n in data.class_counts}}
    meta = {"mode": "validate", "run_name": name, "timestamp": when, "config": config, "dataset": about, "partitions": {"exported": exported, "format": "csv", "path": "partitions/"}}
    sinks.write_json(run / "meta.json", meta | {"folds": folds, "folds_truncated": n_folds > LISTED, "n_folds": n_folds})
    assigned.unpersist()
    return run


def _single(config: dict) -> bool:
    """Whether tables are single files (the default) or folders of parts, for results that one task should not write."""
    return as_truth((config.get("report") or {}).get("single_files", True))


def _about(config: dict, data: Labelled) -> dict:
    classes = {"classes": data.classes} if data.class_table is None else {"n_classes": data.n_classes}
    return {"path": (config.get("io") or {}).get("dataset"), "n_samples": data.n, "n_features": data.width, "target_col": data.target} | classes


def _sparse_report(run: RunDirectory, found: DataFrame, labels: DataFrame | list[str], n_labels: int, config: dict) -> dict:
    """For more labels than a matrix of all pairs has room for: cells that occur, and per-label metrics, as tables."""
    cm = evaluate.occurring(found, labels).persist()
    for name, matrix in (("confusion_matrix", cm), ("confusion_matrix_norm_rows", evaluate.by_rows(cm)), ("confusion_matrix_norm_cols", evaluate.by_columns(cm))):
        sinks.write_csv(matrix, run / f"{name}.csv", ["true_label", "pred_label"], _single(config))
    each = evaluate.per_class(cm, labels).join(evaluate.support(found, labels), "label_s").withColumnRenamed("label_s", "label")
    sinks.write_csv(each, run / "metrics_per_class.csv", ["label"], _single(config))
    one = evaluate.summary(cm, n_labels).first()
    found_metrics = {k: one[k] for k in ("accuracy", "balanced_accuracy", "mcc")} | {"macro": {k: one[f"macro_{k}"] for k in evaluate.RATES}, "per_class": "metrics_per_class.csv", "n_labels": n_labels}
    sinks.write_json(run / "metrics.json", found_metrics)
    cm.unpersist()
    return found_metrics


def _reported(run: RunDirectory, found: DataFrame, labels: DataFrame | list[str], n_labels: int, config: dict) -> dict:
    if n_labels > evaluate.LABELS:
        return _sparse_report(run, found, labels, n_labels, config)
    cm = evaluate.confusion(found, labels).persist()
    shares = {"confusion_matrix": (cm, "n"), "confusion_matrix_norm_rows": (evaluate.by_rows(cm), "share"), "confusion_matrix_norm_cols": (evaluate.by_columns(cm), "share")}
    shown = as_truth((config.get("report") or {}).get("confusion_matrix_display", False))
    for name, (matrix, value) in shares.items():
        table = evaluate.wide(matrix, labels, value)
        sinks.write_matrix(table, run / f"{name}.csv")
        if shown:
            title = {"confusion_matrix": "Confusion Matrix", "confusion_matrix_norm_rows": "Confusion Matrix (Normalized by Rows)"}.get(name, "Confusion Matrix (Normalized by Columns)")
            sinks.draw([list(r)[1:] for r in table.collect()], labels, run / f"{name}.png", title, value == "share")
    found_metrics = evaluate.metrics(cm, found, labels)
    sinks.write_json(run / "metrics.json", found_metrics)
    cm.unpersist()
    return found_metrics


def _outputs(run: RunDirectory, first: str) -> dict:
    names = {first: f"{first.removesuffix('_csv')}.csv", "confusion_matrix_csv": "confusion_matrix.csv", "confusion_matrix_norm_rows_csv": "confusion_matrix_norm_rows.csv", "confusion_matrix_norm_cols_csv": "confusion_matrix_norm_cols.csv", "metrics_json": "metrics.json"}
    return {k: str(run / v) for k, v in names.items()}


def _summary(found: dict) -> dict:
    return {k: found[k] for k in ("accuracy", "balanced_accuracy", "mcc")}


def classify(spark: SparkSession, config: dict, outputs: str = "outputs") -> RunDirectory:
    """One split: two files, or one file dealt by a splitter that gives a single split."""
    when = sinks.stamp()
    run = RunDirectory.create(spark, outputs, str(config.get("run_name", "classify")), when)
    source = config.get("io") or {}
    what = classifier(config.get("classifier") or {})
    if source.get("train_dataset") and source.get("test_dataset"):
        mode, target, drops = "classify_train_test", str(source.get("target_col", "class")), list(source.get("drop_cols") or [])
        train, test = (read_csv(spark, str(source[k]), target, drops) for k in ("train_dataset", "test_dataset"))
        found = between(train, test, what)
        labels = evaluate.merged_labels(train.frame, test.frame).select("label_s")
        n_labels = labels.count()
        if n_labels <= CLASSES:
            labels = sorted(r[0] for r in labels.collect())
        sizes, width = (train.n, test.n), (train.width, test.width)
    else:
        mode, data = "classify_dataset_split", dataset(spark, config)
        spec = config.get("mode") or {}
        if spec.get("type") != "dataset_split":
            raise ConfigError("classify needs io.train_dataset and io.test_dataset, or mode.type dataset_split with mode.split")
        how = splitter(spec.get("split") or {}, "mode.split")
        if not isinstance(how, Holdout):
            raise ConfigError("classify takes a splitter with one split, such as holdout; folds are for run")
        found = predictions(data, how, what)
        n_test = found.count()
        n_labels, sizes, width = data.n_classes, (data.n - n_test, n_test), (data.width, data.width)
        labels = data.classes if data.class_table is None else data.class_table.select("label_s")
    found = found.persist()
    sinks.write_csv(found.select(F.col("row_idx").alias("index"), "y_true", "y_pred"), run / "predictions.csv", ["index"], _single(config))
    metrics = _reported(run, found, labels, n_labels, config)
    sinks.write_json(
        run / "meta.json",
        {
            "mode": mode,
            "run_name": str(config.get("run_name", mode)),
            "timestamp": when,
            "config": config,
            "train": {"n_samples": sizes[0], "n_features": width[0]},
            "test": {"n_samples": sizes[1], "n_features": width[1]},
            **({"labels": labels} if isinstance(labels, list) else {"n_labels": n_labels}),
            "summary": _summary(metrics),
            "outputs": _outputs(run, "predictions_csv"),
        },
    )
    found.unpersist()
    return run


def run(spark: SparkSession, config: dict, outputs: str = "outputs") -> RunDirectory:
    """Every fold's predictions, pooled."""
    name, when = str(config.get("run_name", "run")), sinks.stamp()
    place = RunDirectory.create(spark, outputs, name, when)
    data = dataset(spark, config)
    how, what = splitter(config.get("validation") or {}), classifier(config.get("classifier") or {})
    found = predictions(data, how, what).persist()
    sinks.write_csv(found.select("fold", F.col("row_idx").alias("index"), "y_true", "y_pred"), place / "fold_predictions.csv", ["fold", "index"], _single(config))
    labels = data.classes if data.class_table is None else data.class_table.select("label_s")
    metrics = _reported(place, found, labels, data.n_classes, config)
    n_folds = found.select("fold").distinct().count()
    meta = {"mode": "run", "run_name": name, "timestamp": when, "config": config, "dataset": _about(config, data), "n_folds": n_folds}
    sinks.write_json(place / "meta.json", meta | {"outputs": _outputs(place, "fold_predictions_csv"), "summary": _summary(metrics)})
    found.unpersist()
    return place

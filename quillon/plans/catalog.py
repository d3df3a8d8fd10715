"""Named queries over the test tables, one or more for each operator of the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.distances import distance
from quillon.operators import evaluate
from quillon.operators.classify import Knn, NearestCentroid, Shape
from quillon.operators.folds import Holdout, KFold, LeaveOneOut, fold_stats, partitions, quota_table
from quillon.plans import experiment, oracle
from quillon.plans.config import put, scalar
from quillon.sources import sinks
from quillon.sources.labelled import Labelled, from_columns, from_vectors, read_csv
from quillon.sources.shared import remember, shared_path
from quillon.streaming import scoring

FOLDS5 = KFold(5, stratify=True, shuffle=False)
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RATES = ("precision", "recall", "sensitivity", "specificity", "f1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, d) -> Labelled:
    return from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def customers(spark, d) -> Labelled:
    return from_columns(table(spark, d, "customer"), "c_mktsegment", "c_custkey", features=["c_acctbal"])


def parts(spark, d) -> Labelled:
    return from_columns(table(spark, d, "part"), "p_brand", "p_partkey", features=["p_size", "p_retailprice"])


def nation_balances(spark, d) -> Labelled:
    return from_columns(table(spark, d, "customer"), "c_nationkey", "c_custkey", features=["c_acctbal"])


def graded(spark, d) -> Labelled:
    met = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return from_columns(met, "quality", "doc_id", features=["n_chars"])


def lines(spark, d) -> Labelled:
    """lineitem has no key: its rows are numbered in the order they are read."""
    return from_columns(table(spark, d, "lineitem"), "l_returnflag", features=MEASURES)


def nations(spark, d) -> tuple[Labelled, Labelled]:
    """Suppliers to train on and customers to test: account balance against nation."""
    train = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    test = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))
    return from_columns(train, "nation", "id"), from_columns(test, "nation", "id")


def shown(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.col("fold").cast("long").alias("fold"), "row_idx", "true_s", "pred_s")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- scans and splitters -------------------------------------------------------------------------


def feature_scan(spark, d):
    frame = parts(spark, d).frame
    return frame.select("row_idx", "label_s", F.get("features", F.lit(0)).alias("f0"), F.get("features", F.lit(1)).alias("f1"))


def row_numbers(spark, d):
    """Numbers of a table without a key: what they are depends on reading order, that they have no gaps does not."""
    return lines(spark, d).frame.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("low"), F.max("row_idx").alias("high"), F.countDistinct("row_idx").alias("distinct_n"))


def class_counts(spark, d):
    return customers(spark, d).frame.groupBy("label_s").agg(F.count(F.lit(1)).alias("n"))


def class_dictionary(spark, d):
    events = from_columns(table(spark, d, "events"), "event_type", "event_id", features=["value"])
    return spark.createDataFrame(list(enumerate(events.classes)), "position long, label_s string")


def _folds(how):
    def query(spark, d):
        return how.assign(customers(spark, d)).select("row_idx", F.col("fold_id").cast("long").alias("fold_id"))

    return query


def holdout_strat_imbalanced(spark, d):
    return Holdout(0.25, 7).assign(graded(spark, d)).select("row_idx", F.col("fold_id").cast("long").alias("fold_id"))


def kfold_fold_stats(spark, d):
    orders = from_columns(table(spark, d, "orders"), "o_orderstatus", "o_orderkey", features=["o_totalprice"])
    return fold_stats(KFold(10, stratify=True, shuffle=True).assign(orders), orders.classes).withColumn("fold_id", F.col("fold_id").cast("long"))


def loo_fold_stats(spark, d):
    data = graded(spark, d)
    return fold_stats(LeaveOneOut().assign(data), data.classes).withColumn("fold_id", F.col("fold_id").cast("long"))


def partition_export_rows(spark, d):
    assigned = FOLDS5.assign(graded(spark, d))
    return partitions(assigned, FOLDS5.n_splits).select(F.col("fold").cast("long").alias("fold"), "role", "row_idx", "label_s")


# --- files ---------------------------------------------------------------------------------------


def _csv_of(spark, d, name: str, columns: list[str], key: str) -> str:
    """A table's columns as a CSV file in the shared folder, in the order of its key."""
    place = sinks.Place(spark, remember(spark, shared_path(spark, name))) / f"{name}.csv"
    sinks.write_csv(table(spark, d, name).select(*columns), place, [key])
    return place.path


def csv_scan(spark, d):
    """Numbers and text of a CSV file, with two columns dropped and types told from the values."""
    path = _csv_of(spark, d, "part", ["p_partkey", "p_size", "p_retailprice", "p_brand", "p_name"], "p_partkey")
    data = read_csv(spark, path, "p_brand", ["p_name", "p_partkey"])
    return data.frame.select("row_idx", "label_s", F.get("features", F.lit(0)).alias("f0"), F.get("features", F.lit(1)).alias("f1"))


def csv_columns(spark, d):
    """What is known of a CSV file before any row is used: its features in order, and its rows."""
    path = _csv_of(spark, d, "customer", ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"], "c_custkey")
    data = read_csv(spark, path, "c_mktsegment", ["c_nationkey"])
    return spark.createDataFrame([(i, name, data.n) for i, name in enumerate(data.feature_names)], "position long, feature string, n long")


CLASHING = ["row_idx", "_at", "_part", "A", "a"]


def _clashing(spark, d) -> DataFrame:
    """part's numbers under names that the engine uses itself or that only case tells apart, and a label that CSV has to quote."""
    numbers = [F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") * 2, F.col("p_size") * 3, F.col("p_retailprice")]
    label = F.concat("p_brand", F.lit(',\n"'), F.substring("p_brand", -1, 1), F.lit('" '))
    return table(spark, d, "part").select(*numbers, label).toDF(*CLASHING, "class")


def csv_quoted_scan(spark, d):
    """A CSV file with quotes, commas and line ends in its fields, read in splits."""
    place = sinks.Place(spark, remember(spark, shared_path(spark, "quoted"))) / "quoted.csv"
    sinks.write_csv(_clashing(spark, d), place, ["row_idx"])
    frame = read_csv(spark, place.path).frame
    return frame.select("row_idx", "label_s", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(len(CLASHING))])


def clashing_columns(spark, d):
    frame = from_columns(_clashing(spark, d), "class", "row_idx", features=CLASHING).frame
    return frame.select("row_idx", "label_s", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(len(CLASHING))])


def float_labels(spark, d):
    """Labels from 1e-7 to 50e17 as text."""
    number = F.concat(F.col("p_size").cast("string"), F.lit("e"), (F.col("p_partkey") % 25 - 7).cast("string")).cast("double")
    data = from_columns(table(spark, d, "part").select("p_partkey", "p_size", number.alias("class")), "class", "p_partkey")
    return data.frame.select("row_idx", "label_s")


def _experiment(spark, d, verb: str, more: dict) -> sinks.RunDirectory:
    path = _csv_of(spark, d, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"], "c_custkey")
    config = {"run_name": verb, "io": {"dataset": path, "target_col": "c_mktsegment", "drop_cols": ["c_custkey"]}, "classifier": {"type": "euclidiano"}}
    return getattr(experiment, verb)(spark, config | more, remember(spark, shared_path(spark, verb)))


FOLDED = {"validation": {"type": "kfold", "params": {"n_splits": 5, "shuffle": False}}}
SPLIT = {"mode": {"type": "dataset_split", "split": {"type": "holdout", "params": {"test_size": 0.2, "seed": 42}}}}


def _read_back(spark, place, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(place.path)


def run_predictions_file(spark, d):
    return _read_back(spark, _experiment(spark, d, "run", FOLDED) / "fold_predictions.csv", "fold long, `index` long, y_true string, y_pred string")


def classify_predictions_file(spark, d):
    return _read_back(spark, _experiment(spark, d, "classify", SPLIT) / "predictions.csv", "`index` long, y_true string, y_pred string")


def run_metrics_file(spark, d):
    found = spark.read.option("multiLine", True).json((_experiment(spark, d, "run", FOLDED) / "metrics.json").path)
    return rounded(found.select("accuracy", "balanced_accuracy", "mcc", F.col("macro.f1").alias("macro_f1"), F.size("labels").cast("long").alias("n_labels")), "accuracy", "balanced_accuracy", "mcc", "macro_f1")


def run_matrix_file(spark, d):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return _read_back(spark, _experiment(spark, d, "run", FOLDED) / "confusion_matrix.csv", ", ".join(["label string", *(f"pred_{x} long" for x in names)]))


def run_meta_file(spark, d):
    found = spark.read.option("multiLine", True).json((_experiment(spark, d, "run", FOLDED) / "meta.json").path)
    return found.select("mode", "run_name", "n_folds", F.col("dataset.n_samples").alias("n_samples"), F.col("dataset.n_features").alias("n_features"))


def classify_meta_file(spark, d):
    found = spark.read.option("multiLine", True).json((_experiment(spark, d, "classify", SPLIT) / "meta.json").path)
    return found.select("mode", F.col("train.n_samples").alias("n_train"), F.col("test.n_samples").alias("n_test"), F.size("labels").cast("long").alias("n_labels"))


def validate_meta_file(spark, d):
    found = spark.read.option("multiLine", True).json((_experiment(spark, d, "validate", FOLDED) / "meta.json").path)
    return found.select(F.explode("folds").alias("f")).select("f.fold", "f.train_size", "f.test_size", F.col("f.test_class_counts.BUILDING").alias("building"))


def _pair(spark, d) -> sinks.RunDirectory:
    """Nations of customers told from balances of suppliers, each from a CSV file of its own."""
    files = {}
    for role, name, key, initial in (("train_dataset", "supplier", "s_suppkey", "s"), ("test_dataset", "customer", "c_custkey", "c")):
        place = sinks.Place(spark, remember(spark, shared_path(spark, role))) / f"{name}.csv"
        rows = table(spark, d, name).select(F.col(key).alias("id"), F.col(f"{initial}_acctbal").alias("balance"), F.col(f"{initial}_nationkey").alias("nation"))
        sinks.write_csv(rows, place, ["id"])
        files[role] = place.path
    config = {"io": files | {"target_col": "nation", "drop_cols": ["id"]}, "classifier": {"type": "knn", "params": {"k": 3}}}
    return experiment.classify(spark, config, remember(spark, shared_path(spark, "pair")))


def classify_pair_predictions_file(spark, d):
    return _read_back(spark, _pair(spark, d) / "predictions.csv", "`index` long, y_true string, y_pred string")


def classify_pair_meta_file(spark, d):
    found = spark.read.option("multiLine", True).json((_pair(spark, d) / "meta.json").path)
    return found.select("mode", F.col("train.n_samples").alias("n_train"), F.col("test.n_samples").alias("n_test"), F.size("labels").cast("long").alias("n_labels"))


def validate_loo_meta_file(spark, d):
    """All folds of leave-one-out are counted, the first of them listed."""
    found = spark.read.option("multiLine", True).json((_experiment(spark, d, "validate", {"validation": {"type": "loo"}}) / "meta.json").path)
    return found.select(F.explode("folds").alias("f")).select("f.fold", "f.train_size", "f.test_size", F.col("f.test_class_counts.BUILDING").alias("building"))


#: Values as the command line has them: a mapping, a word, a number, and a path through what is no mapping yet.
OVERRIDES = ["validation=none", "validation.type=k-fold", "validation.params={n_splits: 9, shuffle: false}", "validation.params.n_splits=4", "validation.params.stratify=True", "classifier.type=centroid"]


def run_overridden_file(spark, d):
    """Predictions of an experiment whose declaration is overridden value by value."""
    declared: dict = {"classifier": {"type": "knn"}}
    for one in OVERRIDES:
        path, _, value = one.partition("=")
        put(declared, path, scalar(value))
    return _read_back(spark, _experiment(spark, d, "run", declared) / "fold_predictions.csv", "fold long, `index` long, y_true string, y_pred string")


def exported_partition_files(spark, d):
    """Rows and sum of a column in each file of an export."""
    run = _experiment(spark, d, "validate", {"validation": FOLDED["validation"] | {"export": {"csv": True}}})
    read = []
    for fold in range(5):
        for role in ("train", "test"):
            rows = _read_back(spark, run / "partitions" / f"fold_{fold}" / f"{role}.csv", "c_acctbal double, c_mktsegment string")
            read.append(rows.agg(F.lit(fold).cast("long").alias("fold"), F.lit(role).alias("role"), F.count("c_acctbal").alias("n"), F.sum("c_acctbal").alias("total")))
    return rounded(reduce(DataFrame.unionAll, read), "total")


# --- distances and classifiers -------------------------------------------------------------------


def _whole(data: Labelled) -> Shape:
    return Shape(data.width, data.n, data.n, 1, tuple(data.classes))


def _to_centroids(metric):
    def query(spark, d):
        data = vectors(spark, d)
        frame = data.frame.withColumn("fold_id", F.lit(-1).cast("long"))
        model = NearestCentroid().fit(frame, _whole(data)).select(F.col("label_s").alias("to_class"), "centroid")
        gap = distance(metric).between(F.col("features"), F.col("centroid"), data.width)
        # As many centroids as classes, whatever the table's size.
        return frame.join(F.broadcast(model)).select("row_idx", "to_class", F.round(gap, 6).alias("d"))

    return query


MINKOWSKI = {"type": "minkowski", "params": {"p": 3}}


def knn_neighbors_topk(spark, d):
    data = vectors(spark, d)
    assigned = LeaveOneOut().assign(data)
    near = Knn(5).neighbours(assigned, assigned, _whole(data))
    return near.select("row_idx", F.col("nth").cast("long").alias("nth"), F.col("r_idx").alias("neighbour"), F.round("d", 6).alias("d"))


def knn_pruned_topk(spark, d):
    """Neighbours by size and price, most pairs being ruled out by the triangle inequality."""
    data = parts(spark, d)
    assigned = LeaveOneOut().assign(data)
    near = Knn(5, prune=True).neighbours(assigned, assigned, _whole(data))
    return near.select("row_idx", F.col("nth").cast("long").alias("nth"), F.col("r_idx").alias("neighbour"), F.round("d", 6).alias("d"))


def _predicted(load, how, what):
    return lambda spark, d: shown(experiment.predictions(load(spark, d), how, what))


def centroid_fit(spark, d):
    data = lines(spark, d)
    model = NearestCentroid().fit(data.frame.withColumn("fold_id", F.lit(-1).cast("long")), _whole(data))
    return model.select("label_s", "n", *[F.round(F.get("centroid", F.lit(i)), 6).alias(f"c{i}") for i in range(data.width)])


def centroid_train_test_predict(spark, d):
    train, test = nations(spark, d)
    return shown(experiment.between(train, test, NearestCentroid()))


def knn_train_test_predict(spark, d):
    train, test = nations(spark, d)
    return shown(experiment.between(train, test, Knn(3)))


def centroid_lineitem_confusion(spark, d):
    data = lines(spark, d)
    return evaluate.confusion(experiment.between(data, data, NearestCentroid()), data.classes)


def stream_confusion(spark, d):
    """Events replayed as a stream: types told from values by their nearest neighbours in a table, and each day's confusion matrix kept as state."""
    events = table(spark, d, "events")
    train = from_columns(events.where(F.col("event_id") % 5 == 0), "event_type", "event_id", features=["value"])
    places = [remember(spark, shared_path(spark, name)) for name in ("predicted", "predicted_state", "cells", "cells_state")]
    # A pattern, as a stream's source is one or a folder. Times without a zone count as UTC, whatever the session's zone.
    replay = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").where(F.col("event_id") % 5 != 0)
    ts = F.col("ts") if events.schema["ts"].dataType.typeName() == "timestamp" else F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp")
    rows = replay.select(F.col("event_id").alias("row_idx"), F.col("event_type").alias("label"), F.array("value").alias("features"), ts.alias("ts"))
    scoring.neighbours_stream(rows, train, Knn(3, prune=True), *places[:2]).awaitTermination()
    predicted = spark.readStream.schema("row_idx long, true_s string, pred_s string, ts timestamp").parquet(f"{places[0]}/batch=*")
    scoring.confusion_stream(predicted, *places[2:]).awaitTermination()
    day = F.date_from_unix_date(F.floor(F.unix_micros("start") / 86_400_000_000).cast("int"))
    return scoring.matrix(spark, places[2]).withColumn("start", day.cast("string"))


# --- evaluation ----------------------------------------------------------------------------------


def _pooled(spark, d):
    data = vectors(spark, d)
    return experiment.predictions(data, FOLDS5, NearestCentroid()), data.classes


def confusion_long(spark, d):
    return evaluate.confusion(*_pooled(spark, d))


def confusion_wide(spark, d):
    found, labels = _pooled(spark, d)
    return evaluate.wide(evaluate.confusion(found, labels), labels)


def confusion_norm_rows(spark, d):
    return rounded(evaluate.by_rows(confusion_long(spark, d)), "share")


def confusion_norm_cols(spark, d):
    return rounded(evaluate.by_columns(confusion_long(spark, d)), "share")


def confusion_of_some(spark, d):
    """Predictions whose true or predicted label is not listed are left out; a listed label without rows stays."""
    return evaluate.confusion(_pooled(spark, d)[0], ["0", "3", "7", "none"])


def matrix_drawing(spark, d):
    """The table behind a drawing of shares."""
    return rounded(sinks.tidy(evaluate.by_rows(confusion_long(spark, d)), "Confusion Matrix (Normalized by Rows)", "share"), "value")


def row_numbers_of_join(spark, d):
    """Numbers of rows that come out of a shuffle, which Spark may deal anew whenever it evaluates them."""
    met = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).repartition("l_suppkey")
    data = from_columns(met, "o_orderstatus", features=MEASURES)
    counted = data.frame.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("low"), F.max("row_idx").alias("high"), F.countDistinct("row_idx").alias("distinct_n"))
    return counted.withColumn("known_n", F.lit(data.n).cast("long"))


def _sparse(spark, d):
    train, test = nations(spark, d)
    labels = evaluate.merged_labels(train.frame, test.frame)
    return evaluate.occurring(experiment.between(train, test, NearestCentroid()), labels), labels


def confusion_sparse(spark, d):
    return _sparse(spark, d)[0]


def metrics_sparse_per_class(spark, d):
    """From the cells that occur; labels without any are listed too."""
    return rounded(evaluate.per_class(*_sparse(spark, d)), *RATES)


def metrics_sparse_summary(spark, d):
    cm, labels = _sparse(spark, d)
    # One label more than there are: it enters the means by its number alone.
    found = evaluate.summary(cm, labels.count() + 1)
    return rounded(found, *found.columns)


def holdout_joined_quotas(spark, d):
    """Quotas of classes as a table, in closed form: as many repaired as the total asks for."""
    data = from_columns(table(spark, d, "part"), "p_brand", "p_partkey", features=["p_size"])
    return quota_table(data, 0.333)


def metrics_per_class(spark, d):
    return rounded(evaluate.per_class(confusion_long(spark, d)), *RATES)


def metrics_macro(spark, d):
    macro = evaluate.summary(confusion_long(spark, d))
    return rounded(macro.select(*[f"macro_{c}" for c in RATES], "balanced_accuracy"), *[f"macro_{c}" for c in RATES], "balanced_accuracy")


def metrics_mcc(spark, d):
    return rounded(evaluate.overall(confusion_long(spark, d)), "accuracy", "mcc")


def support(spark, d):
    return evaluate.support(*_pooled(spark, d))


def merged_labels(spark, d):
    train, test = nations(spark, d)
    return evaluate.merged_labels(train.frame, test.frame)


def pooled_run_summary(spark, d):
    data = vectors(spark, d)
    cm = evaluate.confusion(experiment.predictions(data, FOLDS5, Knn(3)), data.classes)
    return rounded(evaluate.overall(cm), "accuracy", "mcc")


def lineitem_metrics(spark, d):
    return rounded(evaluate.per_class(centroid_lineitem_confusion(spark, d)), *RATES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 5-fold, 3 nearest neighbours, all folds in one plan."""
    return shown(experiment.predictions(vectors(spark, sf_dir), FOLDS5, Knn(3)))


def queries() -> dict:
    plain = [
        feature_scan, row_numbers, class_counts, class_dictionary, holdout_strat_imbalanced, kfold_fold_stats, loo_fold_stats, partition_export_rows, knn_neighbors_topk, centroid_fit, centroid_train_test_predict,
        knn_train_test_predict, centroid_lineitem_confusion, confusion_long, confusion_wide, confusion_norm_rows, confusion_norm_cols, metrics_per_class, metrics_macro, metrics_mcc, support, merged_labels, pooled_run_summary, lineitem_metrics,
        csv_scan, csv_columns, run_predictions_file, classify_predictions_file, run_metrics_file, run_matrix_file, run_meta_file, classify_meta_file, validate_meta_file, exported_partition_files, confusion_of_some, matrix_drawing, row_numbers_of_join,
        csv_quoted_scan, clashing_columns, float_labels, knn_pruned_topk, confusion_sparse, metrics_sparse_per_class, metrics_sparse_summary, holdout_joined_quotas, stream_confusion,
        classify_pair_predictions_file, classify_pair_meta_file, validate_loo_meta_file, run_overridden_file,
    ]
    return {f.__name__: f for f in plain} | {
        "kfold_plain_assign": _folds(KFold(5, stratify=False, shuffle=False)),
        "kfold_plain_shuffled": _folds(KFold(5, stratify=False)),
        "kfold_strat_assign": _folds(FOLDS5),
        "kfold_strat_shuffled": _folds(KFold(5)),
        "holdout_plain": _folds(Holdout(0.2, stratify=False)),
        "holdout_strat": _folds(Holdout(0.2)),
        "dist_euclidean": _to_centroids("euclidean"),
        "dist_manhattan": _to_centroids("manhattan"),
        "dist_chebyshev": _to_centroids("chebyshev"),
        "dist_minkowski": _to_centroids(MINKOWSKI),
        "knn_kfold_predict": _predicted(vectors, FOLDS5, Knn(3)),
        "knn_blocked_predict": _predicted(vectors, FOLDS5, Knn(3, blocks=4)),
        "knn_pruned_predict": _predicted(vectors, FOLDS5, Knn(3, prune=True)),
        "knn_pruned_manhattan_predict": _predicted(nation_balances, Holdout(0.25, 7), Knn(5, distance("manhattan"), prune=True)),
        "knn_holdout_predict": _predicted(vectors, Holdout(0.25, 7), Knn(5)),
        "knn_loo_1nn_predict": _predicted(vectors, LeaveOneOut(), Knn(1)),
        "knn_manhattan_predict": _predicted(vectors, FOLDS5, Knn(3, distance("manhattan"))),
        "knn_chebyshev_predict": _predicted(vectors, FOLDS5, Knn(3, distance("chebyshev"))),
        "knn_minkowski_predict": _predicted(vectors, FOLDS5, Knn(3, distance(MINKOWSKI))),
        "knn_vote_tiebreak": _predicted(lambda s, d: from_columns(table(s, d, "part"), "p_brand", "p_partkey", features=["p_size"]), FOLDS5, Knn(4)),
        "centroid_kfold_predict": _predicted(vectors, FOLDS5, NearestCentroid()),
        "centroid_loo_predict": _predicted(vectors, LeaveOneOut(), NearestCentroid()),
        "centroid_loo_small_predict": _predicted(customers, LeaveOneOut(), NearestCentroid()),
    }


def oracle_sql() -> dict:
    return oracle.statements()

"""Confusion matrices and what follows from them, over text forms of labels.

Predictions are frames with ``true_s`` and ``pred_s``. Matrices are long, (true_label, pred_label, n): with every pair
of the labels listed, to be turned wide where written, or sparse, with the cells that occur. Metrics follow from either: they
are made from cells that occur and totals of labels, and labels that don't occur enter means by their number. What a
sparse matrix takes grows with the predictions, not with the square of the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import DataError
from quillon.sources.shared import bounded


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


#: Most labels that a matrix with all their pairs is made for; those of more are sparse.
LABELS = 1_000

Labels = list[str] | DataFrame


def _labels(spark, labels: list[str]) -> DataFrame:
    if len(labels) > LABELS:
        raise DataError(f"a confusion matrix of {len(labels)} labels would have {len(labels) ** 2} cells; {LABELS} labels are the most")
    return spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "ord int, label_s string")


def _names(spark, labels: Labels) -> DataFrame:
    """label_s of each label, any number of them; a list is broadcast if it is short."""
    if isinstance(labels, DataFrame):
        return labels.select("label_s").distinct()
    return bounded(spark.createDataFrame([(x,) for x in labels], "label_s string"), len(labels))


def occurring(predictions: DataFrame, labels: Labels) -> DataFrame:
    """true_label, pred_label, n of the cells that occur; predictions whose true or predicted label is not listed are left out."""
    seen = predictions.groupBy(F.col("true_s").alias("true_label"), F.col("pred_s").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    names = _names(predictions.sparkSession, labels)
    for side in ("true_label", "pred_label"):
        seen = seen.join(names.withColumnRenamed("label_s", side), side, "left_semi")
    return seen.select("true_label", "pred_label", "n")


def confusion(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """true_label, pred_label, n: all pairs of the labels listed; other predictions are left out."""
    names = F.broadcast(_labels(predictions.sparkSession, labels))
    grid = names.select(F.col("label_s").alias("true_label")).join(names.select(F.col("label_s").alias("pred_label")))
    seen = predictions.groupBy(F.col("true_s").alias("true_label"), F.col("pred_s").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n"))


def _share(cm: DataFrame, side: str) -> DataFrame:
    """The matrix divided by its rows' or columns' sums; those of sum 0 stay 0. It has labels squared rows."""
    total = F.sum("n").over(Window.partitionBy(side))
    return cm.select("true_label", "pred_label", ratio(F.col("n"), total).alias("share"))


def by_rows(cm: DataFrame) -> DataFrame:
    return _share(cm, "true_label")


def by_columns(cm: DataFrame) -> DataFrame:
    return _share(cm, "pred_label")


def wide(cm: DataFrame, labels: list[str], value: str = "n") -> DataFrame:
    """true_<label> in rows, pred_<label> in columns, in the order of the labels."""
    cells = [F.max(F.when(F.col("pred_label") == x, F.col(value))).alias(f"pred_{x}") for x in labels]
    place = F.element_at(F.create_map(*[y for i, x in enumerate(labels) for y in (F.lit(x), F.lit(i))]), F.col("true_label"))
    rows = cm.groupBy("true_label").agg(*cells)
    return rows.orderBy(place).withColumn("true_label", F.concat(F.lit("true_"), "true_label")).withColumnRenamed("true_label", "label")


def support(predictions: DataFrame, labels: Labels) -> DataFrame:
    """label_s, support: rows that truly have each label, whatever was predicted."""
    seen = predictions.groupBy(F.col("true_s").alias("label_s")).agg(F.count(F.lit(1)).alias("support"))
    return _names(predictions.sparkSession, labels).join(seen, "label_s", "left").select("label_s", F.coalesce("support", F.lit(0)).alias("support"))


def _sums(cm: DataFrame) -> DataFrame:
    """label_s, row, col, tp as doubles: each cell counts for its true and for its predicted label, in one pass."""
    zero, hit = F.lit(0).cast("long"), F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    as_true = F.struct(F.col("true_label").alias("label_s"), F.col("n").alias("row"), zero.alias("col"), hit.cast("long").alias("tp"))
    as_pred = F.struct(F.col("pred_label").alias("label_s"), zero.alias("row"), F.col("n").alias("col"), zero.alias("tp"))
    each = cm.select(F.explode(F.array(as_true, as_pred)).alias("x")).select("x.*")
    return each.groupBy("label_s").agg(*[F.sum(c).cast("double").alias(c) for c in ("row", "col", "tp")])


RATES = ("precision", "recall", "sensitivity", "specificity", "f1")


def _rated(sums: DataFrame, total: DataFrame) -> DataFrame:
    """Rates of each label from its sums and the matrix's total, one row."""
    whole = sums.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    tp, fn, fp = F.col("tp"), F.col("row") - F.col("tp"), F.col("col") - F.col("tp")
    counted = whole.select("label_s", *[x.alias(k) for k, x in (("tp", tp), ("fn", fn), ("fp", fp), ("tn", F.col("total") - tp - fn - fp))])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = counted.withColumns({"precision": p, "recall": r, "sensitivity": r, "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp"))})
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_class(cm: DataFrame, labels: Labels | None = None) -> DataFrame:
    """label_s with tp, fn, fp, tn, precision, recall, sensitivity, specificity, f1.

    Labels are those of the matrix; of a sparse one ``labels`` tells those that don't occur too.
    """
    sums = _sums(cm)
    if labels is not None:
        zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("row", "col", "tp")}
        sums = _names(cm.sparkSession, labels).join(sums, "label_s", "left").withColumns(zero)
    return _rated(sums, cm.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total")))


def _overall(row: Column, col: Column, tp: Column) -> tuple[list[Column], list[Column]]:
    """Sums to aggregate, and accuracy and mcc from them."""
    parts = {"_s": row, "_c": tp, "_tp": row * col, "_tt": row * row, "_pp": col * col}
    s, c = F.col("_s"), F.col("_c")
    den = F.sqrt((s * s - F.col("_pp")) * (s * s - F.col("_tt")))
    sums = [F.coalesce(F.sum(x), F.lit(0.0)).alias(k) for k, x in parts.items()]
    return sums, [ratio(c, s).alias("accuracy"), ratio(c * s - F.col("_tp"), den).alias("mcc")]


def summary(cm: DataFrame, n_labels: int | None = None) -> DataFrame:
    """One row: accuracy, macro means over all labels, balanced accuracy and the multiclass MCC.

    Of a sparse matrix ``n_labels`` tells how many labels there are: one without cells has no hit to its name and a specificity of 1.
    """
    sums, overall_columns = _overall(F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"), F.col("tp"))
    totals = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_{c}") for c in RATES]
    one = per_class(cm).agg(F.count(F.lit(1)).alias("_n"), *totals, *sums)
    n = F.col("_n") if n_labels is None else F.lit(n_labels)
    absent = {"specificity": F.when(F.col("_s") > 0, n - F.col("_n")).otherwise(0)}
    means = {c: ratio(F.col(f"_{c}") + absent.get(c, F.lit(0)), n).alias(f"macro_{c}") for c in RATES}
    return one.select(*means.values(), *overall_columns).withColumn("balanced_accuracy", F.col("macro_recall"))


def overall(cm: DataFrame) -> DataFrame:
    """One row: accuracy, mcc."""
    sums, columns = _overall(F.col("row"), F.col("col"), F.col("tp"))
    return _sums(cm).agg(*sums).select(*columns)


def metrics(cm: DataFrame, predictions: DataFrame, labels: list[str]) -> dict:
    """All metrics as a nested mapping; as many numbers as labels come to the driver."""
    one = summary(cm).first()
    classes = {r["label_s"]: r for r in per_class(cm).collect()}
    counted = {r["label_s"]: r["support"] for r in support(predictions, labels).collect()}
    return {
        "accuracy": one["accuracy"],
        "balanced_accuracy": one["balanced_accuracy"],
        "mcc": one["mcc"],
        "macro": {k: one[f"macro_{k}"] for k in RATES},
        "per_class": {x: {"tp": classes[x]["tp"], "fn": classes[x]["fn"], "fp": classes[x]["fp"], "tn": classes[x]["tn"], **{k: classes[x][k] for k in RATES}} for x in labels},
        "support": {x: counted[x] for x in labels},
        "labels": labels,
    }


def merged_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """label_s, label: classes of either frame, told apart by their text; the first frame's form wins."""
    both = first.select("label_s", F.lit(0).alias("rank"), F.col("label").cast("string").alias("label")).distinct().unionByName(second.select("label_s", F.lit(1).alias("rank"), F.col("label").cast("string").alias("label")).distinct())
    return both.groupBy("label_s").agg(F.min_by("label", "rank").alias("label"))

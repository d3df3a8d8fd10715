"""Scoring streams against models and tables that were made before, and evaluating what was scored as it comes.

Nearest centroids are stateless columns.  Nearest neighbours need a join, so each micro-batch meets the training table in a
job of its own, whose result is written under the batch's number: a batch that is run again after a failure replaces what it
had written.  The confusion matrix is state by window of event time, kept until the watermark has passed it; each
batch writes the cells that it changed, and a cell's count is the last that was written, the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.errors import DataError
from quillon.functions.distances import distance
from quillon.operators.classify import Knn, NearestCentroid, Shape, check_k, shape_of
from quillon.sources.labelled import Labelled, label_text
from quillon.sources.shared import bounded


def centroid_model(train: Labelled) -> list[tuple]:
    """(label text, centroid) of each class: as many rows as classes."""
    frame = train.frame.withColumn("fold_id", F.lit(-1).cast("long"))
    shape = Shape(train.width, train.n, 0, 1, tuple(train.classes))
    rows = NearestCentroid().fit(frame, shape).select("label_s", "centroid").collect()
    return sorted((r["label_s"], list(r["centroid"])) for r in rows)


def score(rows: DataFrame, model: list[tuple], features: str = "features") -> DataFrame:
    """The rows, of a stream or not, with ``pred_s``: stateless, so late rows need no watermark."""
    if not model:
        raise ValueError("a model without classes cannot score")
    l2, width = distance("euclidean"), len(model[0][1])
    each = []
    for label, centroid in model:
        d = l2.between(F.col(features), F.array(*[F.lit(x) for x in centroid]), width)
        each.append(F.struct((~F.isnan(d)).alias("a"), d.alias("d"), F.lit(label).alias("label_s")))
    return rows.withColumn("pred_s", F.array_min(F.array(*each))["label_s"])


def _written(place: str, batch: int) -> str:
    return f"{place.rstrip('/')}/batch={batch}"


def neighbours_stream(rows: DataFrame, train: Labelled, what: Knn, place: str, checkpoint: str) -> StreamingQuery:
    """Predictions of a stream of (row_idx, label, features, ts) from a table's rows, written below ``place`` as Parquet.

    Written are row_idx, true_s, pred_s and ts of each row; what has arrived is scored and the query ends.
    """
    if [f.name for f in rows.schema] != ["row_idx", "label", "features", "ts"]:
        raise DataError(f"the stream has to have row_idx, label, features and ts, not {rows.columns}")
    check_k(what, [(0, train.n)])
    known = train.frame.select("*", F.lit(-1).cast("long").alias("fold_id"))
    kind = rows.schema["label"].dataType

    def scored(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        test = held.select("row_idx", "label", label_text(F.col("label"), kind).alias("label_s"), "features", F.lit(0).cast("long").alias("fold_id"))
        n = held.count()
        found = what.predict(known, test, shape_of(train, n, 1))
        # A row's time meets its prediction by its number.
        timed = found.select("row_idx", "true_s", "pred_s").join(bounded(held.select("row_idx", "ts"), n), "row_idx")
        timed.write.mode("overwrite").parquet(_written(place, number))
        held.unpersist()

    return rows.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confusion_stream(predictions: DataFrame, place: str, checkpoint: str, window: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Cells of the confusion matrix of each window, kept as state until ``late`` after it; rows that come later are left out."""
    cells = predictions.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "true_s", "pred_s").agg(F.count(F.lit(1)).alias("n"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "true_s", "pred_s", "n").write.mode("overwrite").parquet(_written(place, number))

    return cells.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matrix(spark: SparkSession, place: str) -> DataFrame:
    """start, true_label, pred_label, n: the matrix that confusion_stream has written so far."""
    found = spark.read.schema("start timestamp, true_s string, pred_s string, n long").parquet(f"{place.rstrip('/')}/batch=*")
    return found.groupBy("start", F.col("true_s").alias("true_label"), F.col("pred_s").alias("pred_label")).agg(F.max("n").alias("n"))

"""Single files from sorted parts, and streams."""

import csv

import pytest
from pyspark.sql import functions as F

from quillon.operators.classify import Knn
from quillon.plans.experiment import between
from quillon.sources import sinks
from quillon.sources.labelled import from_columns
from quillon.streaming import scoring


@pytest.mark.parametrize("opened", [{"file"}, set()])
def test_one_file_of_many_parts(spark, tmp_path, monkeypatch, opened):
    monkeypatch.setattr(sinks, "OPENED", opened)
    settled = []
    join = sinks._appended
    monkeypatch.setattr(sinks, "_appended", lambda parts, target: settled.append(len(parts)) or join(parts, target))
    table = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.concat(F.lit('a,"\n'), F.col("id").cast("string")).alias("K"))
    texts = []
    for coalesced in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        place = sinks.Place(spark, str(tmp_path / f"{coalesced}.csv"))
        try:
            sinks.write_csv(table, place, ["k"])
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        texts.append((tmp_path / f"{coalesced}.csv").read_text())
    assert texts[0] == texts[1] and settled[1] > 2
    rows = list(csv.reader(texts[0].splitlines(keepends=True)))
    assert rows[0] == ["k", "K"] and [int(r[0]) for r in rows[1:]] == list(range(20_000))
    sinks.write_csv(table.limit(0), sinks.Place(spark, str(tmp_path / "none.csv")), ["k"])
    assert (tmp_path / "none.csv").read_text() == "k,K\n"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["false.csv", "none.csv", "true.csv"]


def stream_of(spark, folder):
    return spark.readStream.schema("row_idx long, label string, features array<double>, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_neighbours_and_matrix_of_a_stream(spark, tmp_path):
    rows = [(i, float(i * 37 % 101), "abc"[i * 37 % 101 // 40], f"2024-01-0{1 + i % 3} 0{i % 10}:00:00") for i in range(90)]
    table = spark.createDataFrame(rows, "i long, x double, y string, t string")
    train = from_columns(table.where("i % 3 = 0").select("i", "x", "y"), "y", "i")
    rest = table.where("i % 3 > 0")
    for n in range(3):  # three files, a micro-batch each
        part = rest.where(F.col("i") % 9 == 3 * n + 1) if n < 2 else rest.where(~F.col("i").isin([r[0] for r in rows if r[0] % 9 in (1, 4)]))
        part.select(F.col("i").alias("row_idx"), F.col("y").alias("label"), F.array("x").alias("features"), F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    places = [str(tmp_path / n) for n in ("out", "out_state", "cells", "cells_state")]
    for _ in range(2):  # the second time nothing is new
        scoring.neighbours_stream(stream_of(spark, str(tmp_path / "in")), train, Knn(3), *places[:2]).awaitTermination()
    found = spark.read.parquet(f"{places[0]}/batch=*")
    test = from_columns(rest.select("i", "x", "y"), "y", "i")
    want = {r["row_idx"]: r["pred_s"] for r in between(train, test, Knn(3)).collect()}
    assert {r["row_idx"]: r["pred_s"] for r in found.collect()} == want and found.count() == 60
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    predicted = spark.readStream.schema("row_idx long, true_s string, pred_s string, ts timestamp").option("maxFilesPerTrigger", 2).parquet(f"{places[0]}/batch=*")
    scoring.confusion_stream(predicted, *places[2:], late="10 days").awaitTermination()
    cells = {(str(r["start"])[:10], r["true_label"], r["pred_label"]): r["n"] for r in scoring.matrix(spark, places[2]).collect()}
    days, truth = {r[0]: r[3][:10] for r in rows}, {r[0]: r[2] for r in rows}
    counted = {}
    for i, p in want.items():
        counted[days[i], truth[i], p] = counted.get((days[i], truth[i], p), 0) + 1
    assert cells == counted

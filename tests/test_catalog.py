"""Queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from quillon.plans import catalog

SMALL = "/root/testdata/sf0.001"
#: Those that run in seconds; all are compared at each round's end.
QUICK = ["feature_scan", "row_numbers", "class_counts", "class_dictionary", "holdout_strat", "holdout_strat_imbalanced", "kfold_strat_shuffled", "kfold_plain_shuffled", "kfold_fold_stats", "loo_fold_stats", "dist_minkowski", "knn_kfold_predict", "centroid_kfold_predict", "centroid_train_test_predict", "confusion_wide", "lineitem_metrics", "classify_pair_predictions_file", "classify_pair_meta_file", "validate_loo_meta_file", "run_overridden_file"]


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, tables, name):
    found = catalog.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(map(repr, tables.execute(f"SELECT {listed} FROM ({catalog.oracle_sql()[name]})").fetchall()))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 500
    assert set(catalog.queries()) <= set(entry.queries())


def test_stream_scoring(spark, tmp_path):
    from quillon.operators.classify import NearestCentroid
    from quillon.plans.experiment import between
    from quillon.streaming.scoring import centroid_model, score

    data = catalog.vectors(spark, SMALL)
    data.frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.frame.schema).parquet(str(tmp_path / "in"))
    query = score(stream, centroid_model(data)).select("row_idx", "pred_s").writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {r["row_idx"]: r["pred_s"] for r in between(data, data, NearestCentroid()).collect()}
    assert {r["row_idx"]: r["pred_s"] for r in spark.table("scored").collect()} == want

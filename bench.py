"""Times of the headline queries as one JSON line: python bench.py (BENCH_SF_DIR, BENCH_CPUS)."""

from __future__ import annotations

import json
import os
import re
import time


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quillon.functions.distances import distance
    from quillon.operators import evaluate
    from quillon.operators.classify import Knn, NearestCentroid
    from quillon.operators.folds import KFold, LeaveOneOut, fold_stats
    from quillon.plans import catalog, experiment
    from quillon.sources.shared import drop_durable

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def vectors():
        return catalog.vectors(spark, sf_dir)

    def orders():
        from quillon.sources.labelled import from_columns

        data = from_columns(catalog.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", features=["o_totalprice"])
        return fold_stats(KFold(10).assign(data), data.classes)

    def lines():
        data = catalog.lines(spark, sf_dir)
        return experiment.between(data, data, NearestCentroid())

    minkowski = distance({"type": "minkowski", "params": {"p": 7}})
    work = {
        "w1_knn5_loo": lambda: experiment.predictions(vectors(), LeaveOneOut(), Knn(5)),
        "w2_knn3_5fold": lambda: experiment.predictions(vectors(), KFold(5), Knn(3)),
        "w3_knn53_minkowski_loo": lambda: experiment.predictions(vectors(), LeaveOneOut(), Knn(53, minkowski)),
        "w4_centroid_lineitem": lines,
        "w5_folds_orders": orders,
        "w6_metrics_lineitem": lambda: evaluate.summary(catalog.centroid_lineitem_confusion(spark, sf_dir)),
    }
    # The engine's start is not a query's time.
    spark.range(1000).select(F.sum("id")).collect()
    took = {}
    for name, make in work.items():
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        drop_durable(spark)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

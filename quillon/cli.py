"""Command line: python -m quillon.cli {validate,classify,run} --config FILE [--set key.path=value]..."""

from __future__ import annotations

import argparse
import sys

from quillon.errors import EngineError

VERBS = {"validate": "fold statistics only", "classify": "one split", "run": "every fold of a splitter"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description="Distance-based classification experiments on Spark")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, about in VERBS.items():
        own = verbs.add_parser(verb, help=about)
        own.add_argument("--config", required=True, help="a YAML file")
        own.add_argument("--set", action="append", default=[], metavar="KEY.PATH=VALUE", help="overrides a value; may be given again")
        own.add_argument("--outputs-dir", default="outputs")
    return top


def main(argv: list[str] | None = None, spark=None) -> None:
    from quillon.plans import config, experiment
    from quillon.sources.shared import drop_durable

    args = parser().parse_args(argv)
    try:
        declared = config.load(args.config, args.set)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("quillon").getOrCreate()
        place = getattr(experiment, args.verb)(spark, declared, args.outputs_dir)
    except EngineError as e:
        print(f"ERROR: {e}", file=sys.stderr)
        sys.exit(2)
    drop_durable(spark)
    print(f"OK {args.verb} -> {place.path}")
    for name in ("meta.json", "predictions.csv", "fold_predictions.csv", "metrics.json"):
        if (place / name).exists():
            print(f"  {name}: {place / name}")


if __name__ == "__main__":
    main()

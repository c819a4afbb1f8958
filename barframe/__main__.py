"""Command line: run a study over a file of bars, check it, or print schemas.

    python -m barframe run module:study bars.csv --param length=20 --out folder
    python -m barframe validate module:study
    python -m barframe schema | capabilities
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("study")
    run.add_argument("bars")
    run.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    run.add_argument("--params-json", default="{}")
    run.add_argument("--column", action="append", default=[], metavar="FIELD=NAME")
    run.add_argument("--time-unit", default="s", choices=("s", "ms"))
    run.add_argument("--out", required=True)
    run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    check = sub.add_parser("validate")
    check.add_argument("study")
    sub.add_parser("schema")
    sub.add_parser("capabilities")
    args = parser.parse_args(argv)

    from .plans.engine import Engine, capabilities

    if args.command == "capabilities":
        print(json.dumps(capabilities(), indent=1))
        return 0
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("barframe").getOrCreate())
    if args.command == "schema":
        print(json.dumps(engine.schema(), indent=1))
        return 0
    module, _, name = args.study.partition(":")
    study = getattr(importlib.import_module(module), name or "study")
    if args.command == "validate":
        found = engine.validate(study)
        print("\n".join(found) or "no problem found")
        return int(bool(found))
    pairs = lambda items: dict(x.split("=", 1) for x in items)
    report = engine.run(study, args.bars, json.loads(args.params_json) | pairs(args.param), time_unit=args.time_unit, columns=pairs(args.column))
    report.write(args.out, args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())

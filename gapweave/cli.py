"""python -m gapweave.cli list | run QUERY SF_DIR OUT: one JSON line; errors go to stderr with status 2."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gapweave")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    for name in ("query", "sf_dir", "out"):
        run.add_argument(name)
    args = parser.parse_args(argv)
    from .plans.catalogue import QUERIES

    try:
        if args.command == "list":
            print(json.dumps({"queries": sorted(QUERIES)}))
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        QUERIES[args.query](spark, args.sf_dir).write.mode("errorifexists").parquet(args.out)
        print(json.dumps({"query": args.query, "rows": spark.read.parquet(args.out).count(), "out": args.out}))
        return 0
    except Exception as e:  # noqa: BLE001  the command's own report
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

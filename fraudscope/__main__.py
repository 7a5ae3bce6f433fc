"""Command line: land the transaction CSV as Parquet, or publish a whole run.

    spark-submit -m fraudscope land    --input txns.csv --output txns_parquet [--by-period]
    spark-submit -m fraudscope publish --input txns_parquet --output run_dir [--period-hours 168] [--capacity N]

(or ``python -m fraudscope ...`` with a local session).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from fraudscope.sinks import publish_all
from fraudscope.sources import land_by_period, land_parquet, read_transactions


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fraudscope")
    sub = parser.add_subparsers(dest="command", required=True)
    land = sub.add_parser("land", help="read the CSV with the declared schema, write Parquet")
    land.add_argument("--input", required=True)
    land.add_argument("--output", required=True)
    land.add_argument("--sep", default=",")
    land.add_argument("--by-period", action="store_true", help="partition by weekly period")
    pub = sub.add_parser("publish", help="dashboards, monitoring, alerts, quality and row tables")
    pub.add_argument("--input", required=True)
    pub.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    pub.add_argument("--output", required=True)
    pub.add_argument("--period-hours", type=int, default=168)
    pub.add_argument("--capacity", type=int, default=None)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"fraudscope-{args.command}").getOrCreate()
    if args.command == "land":
        df = read_transactions(spark, args.input, fmt="csv", sep=args.sep)
        (land_by_period if args.by_period else land_parquet)(df, args.output)
        print(json.dumps({"landed": args.output}))
    else:
        df = read_transactions(spark, args.input, fmt=args.format)
        paths = publish_all(df, args.output, args.period_hours, args.capacity)
        print(json.dumps(paths, indent=1))


if __name__ == "__main__":
    main()

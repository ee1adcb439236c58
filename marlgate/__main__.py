"""python -m marlgate COMMAND: build, update, quality, check, query and sql over a lake in generations."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from marlgate.operators import quality
from marlgate.session import local_session
from marlgate.sources.bundle import Bundle, build_bundle
from marlgate.sources.registry import TABLES


def given(spark: SparkSession, pairs: list[str]) -> dict[str, DataFrame]:
    """``table=path`` arguments as frames."""
    named = dict(p.split("=", 1) for p in pairs)
    return {name: spark.read.parquet(path) for name, path in named.items()}


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlgate", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("build", "publish a generation of the given tables"), ("update", "the same, over what is there")):
        one = commands.add_parser(name, help=text)
        one.add_argument("folder")
        one.add_argument("tables", nargs="+", metavar="TABLE=PARQUET")
    checked = commands.add_parser("check", help="compare the files with the manifest")
    checked.add_argument("folder")
    ruled = commands.add_parser("quality", help="write findings and status")
    ruled.add_argument("folder")
    ruled.add_argument("out")
    asked = commands.add_parser("query", help="show rows of a table")
    asked.add_argument("folder")
    asked.add_argument("table", choices=sorted(TABLES))
    for option in ("--fields", "--start", "--end"):
        asked.add_argument(option)
    asked.add_argument("--limit", type=int, default=20)
    spoken = commands.add_parser("sql", help="run a reading statement over the tables")
    spoken.add_argument("folder")
    spoken.add_argument("text")
    args = parser.parse_args(argv)
    spark = spark or local_session()
    if args.command in ("build", "update"):
        print(build_bundle(spark, args.folder, given(spark, args.tables)).name)
        return 0
    bundle = Bundle(spark, args.folder)
    if args.command == "check":
        problems = bundle.problems()
        problems.show(50, truncate=False)
        return 1 if problems.limit(1).count() else 0
    if args.command == "quality":
        frames = {t: bundle.read(t) for t in sorted(bundle.holders)}
        found = [f(frame, TABLES[t]) for t, frame in frames.items() for f in (quality.row_findings, quality.duplicate_keys)]
        quality.write_report(reduce(DataFrame.unionByName, found), args.out)
        return 0
    if args.command == "query":
        bundle.query(args.table, fields=args.fields, start=args.start, end=args.end, limit=args.limit).show(args.limit, truncate=False)
        return 0
    from marlgate.sources.query import check_read_only

    bundle.register(sorted(bundle.holders))
    check_read_only(spark, args.text)
    spark.sql(args.text).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))

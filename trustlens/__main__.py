"""Command line: python -m trustlens score|rescore|export|summary|discover ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from trustlens.plans import jobs
from trustlens.session import build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trustlens")
    commands = top.add_subparsers(dest="command", required=True)
    score = commands.add_parser("score", help="score all channels")
    score.add_argument("--tables", required=True, help="folder with posts, channels and audience")
    score.add_argument("--out", required=True)
    score.add_argument("--as-of", required=True, help="point in time, e.g. '2024-01-31 00:00:00'")
    rescore = commands.add_parser("rescore", help="re-score stored results")
    export = commands.add_parser("export", help="export results as CSV")
    export.add_argument("--status", default="GOOD")
    export.add_argument("--category")
    summary = commands.add_parser("summary", help="counts per status and category")
    discover = commands.add_parser("discover", help="new names linked by good channels")
    discover.add_argument("--tables", required=True)
    for command in (rescore, export, summary, discover):
        command.add_argument("--results", required=True)
        if command is not summary:
            command.add_argument("--out", required=True)
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = build_session()
    if args.command == "score":
        jobs.score_tables(spark, args.tables, args.out, F.to_timestamp(F.lit(args.as_of)))
    elif args.command == "rescore":
        jobs.rescore_table(spark, args.results, args.out)
    elif args.command == "export":
        jobs.export_table(spark, args.results, args.out, args.status, args.category)
    elif args.command == "discover":
        jobs.discover(spark, args.tables, args.results, args.out)
    else:
        for frame in jobs.summary(spark, args.results).values():
            frame.show(50, truncate=False)


if __name__ == "__main__":
    main()

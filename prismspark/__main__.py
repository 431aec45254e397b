"""python -m prismspark analyze-case|report|convergence FOLDER OUT [MANIFEST]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from prismspark import case
from prismspark.sources import media


def main() -> None:
    parser = argparse.ArgumentParser(prog="prismspark")
    parser.add_argument("command", choices=["analyze-case", "report", "convergence"])
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--scores", help="JSON export of other models' scores")
    parser.add_argument("--manifest", help="convergence manifest")
    args = parser.parse_args()
    if args.command == "convergence" and not args.manifest:
        parser.error("convergence needs --manifest")
    spark = SparkSession.builder.getOrCreate()
    scores = media.external_scores(spark, args.scores) if args.scores else None
    found = case.analyze_case(spark, args.folder, scores)
    if args.command == "report":
        found = case.markdown(found)
    elif args.command == "convergence":
        found = case.convergence_benchmark(found, media.convergence_manifest(spark, args.manifest, args.folder))
    media.write_reports(found, args.out)


if __name__ == "__main__":
    main()

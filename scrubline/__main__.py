"""Commands: list queries, run one, mask documents, read a benchmark. Start it with spark-submit or python -m scrubline."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scrubline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    q = sub.add_parser("query", help="run a query over a folder of tables")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("to", help="Parquet folder to write")
    m = sub.add_parser("mask", help="mask the texts of JSON lines or Parquet with doc_id and text")
    m.add_argument("path")
    m.add_argument("to")
    m.add_argument("--dataset", default=None, help="data set whose profile is taken")
    m.add_argument("--profile", default="auto")
    b = sub.add_parser("benchmark", help="read a benchmark's documents")
    b.add_argument("name")
    b.add_argument("root")
    b.add_argument("to")
    b.add_argument("--split", default="test")
    b.add_argument("--limit", type=int, default=None)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    from scrubline.functions import labels
    from scrubline.operators import detection, masking, settings
    from scrubline.plans import catalogue
    from scrubline.plans.ship import ship
    from scrubline.sources import benchmarks

    args = parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if args.command == "query" and args.name not in catalogue.QUERIES:
        parser().error(f"no query {args.name!r}")
    spark = ship(spark or SparkSession.builder.appName("scrubline").getOrCreate())
    if args.command == "query":
        catalogue.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.to)
    elif args.command == "mask":
        docs = spark.read.json(args.path) if args.path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(args.path)
        own = settings.profile(args.profile, args.dataset)
        found = docs.withColumn("spans", F.transform(detection.deterministic(F.col("text")), lambda s: s.withField("label", labels.normalise(s["label"]))))
        masking.mask_documents(found, dict(own.policy), own.default_action).write.mode("overwrite").parquet(args.to)
    else:
        docs, _ = benchmarks.load(spark, args.name, args.root, args.split, args.limit)
        docs.write.mode("overwrite").parquet(args.to)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: ``python -m sondage.cli run|export|page``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .config import FORMATS, Config
from .plans.profile import run_profiler
from .sinks import writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sondage")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="profile the tables of a source")
    run.add_argument("--source", required=True, help="folder, catalog schema or JDBC URL")
    run.add_argument("--kind", default="parquet", help="parquet, orc, csv, json, catalog or jdbc")
    run.add_argument("--database")
    run.add_argument("--schema")
    run.add_argument("--table", action="append")
    run.add_argument("--sample", type=int, default=10_000, help="rows sampled a table; 0 for all")
    run.add_argument("--concurrency", type=int, default=4)
    run.add_argument("--stats-depth", default="full", choices=["full", "fast"])
    run.add_argument("--exact-distinct", action="store_true")
    run.add_argument("--column-batch-size", type=int, default=80)
    run.add_argument("--output-format", default="json", choices=sorted(FORMATS))
    run.add_argument("--output", "-o")
    run.add_argument("--state-dir", help="folder of snapshots and checkpoints")
    run.add_argument("--resume")
    run.add_argument("--incremental", action="store_true")
    run.add_argument("--watermark-column")
    run.add_argument("--prior-run-id")
    run.add_argument("--query-timeout", type=int, default=300, help="seconds a metric may take; 0 for no limit")
    for what in ("patterns", "correlation", "histogram", "benford", "relationships", "duplicates"):
        run.add_argument(f"--no-{what}", action="store_true", help=f"leave out {what}")
    for name, kinds in (("export", sorted(FORMATS)), ("page", ["html"])):
        more = commands.add_parser(name, help="write a stored NDJSON profile in another format")
        more.add_argument("input")
        more.add_argument("--format", default=kinds[0] if len(kinds) == 1 else "openmetadata", choices=kinds)
        more.add_argument("--output", "-o", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sondage").getOrCreate()
    if args.command == "run":
        output = args.output or f"profile.{FORMATS[args.output_format]}"
        config = Config(source=args.source, source_kind=args.kind, database=args.database, schema_name=args.schema, tables=args.table, sample_size=args.sample, concurrency=args.concurrency, stats_depth=args.stats_depth, exact_distinct=args.exact_distinct, column_batch_size=args.column_batch_size, output_format=args.output_format, output=output, state_dir=args.state_dir, resume=args.resume, incremental=args.incremental, watermark_column=args.watermark_column, prior_run_id=args.prior_run_id, query_timeout=args.query_timeout, enable_patterns=not args.no_patterns, enable_correlation=not args.no_correlation, enable_histogram=not args.no_histogram, enable_benford=not args.no_benford, discover_relationships=not args.no_relationships, detect_duplicates=not args.no_duplicates)
        run_id, profiles = run_profiler(spark, config, lambda table, what: print(f"{table}: {what}"))
        print(f"run {run_id}: {len(profiles)} tables, {sum(bool(p.get('error')) for p in profiles)} failed; {output}")
        return int(any(p.get("error") for p in profiles))
    header, *rest = [json.loads(x) for x in Path(args.input).read_text().splitlines()]
    last = rest.pop() if rest and rest[-1].get("_relationships") else {"relationships": []}
    writers.write(args.format, args.output, rest, last["relationships"], header, spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

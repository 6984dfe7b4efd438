"""Command line: ``python -m quern ingest FILE... --out DIR``, ``build --in-jsonl GLOBS | --db FILE --out DIR``, ``inspect DIR``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quern.config import PipelineConfig
from quern.plans import pipeline
from quern.sources.files import expand, only_file
from quern.sources.jsonl import normalized, read_json_lines
from quern.sources.sqlite import read_news_table


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="files into a vector table")
    ingest.add_argument("files", nargs="*", help="without any, the one readable file of ./data")
    ingest.add_argument("--out", required=True)
    ingest.add_argument("--reset", action="store_true")
    build = commands.add_parser("build", help="records into clean documents, chunks and indexes")
    source = build.add_mutually_exclusive_group(required=True)
    source.add_argument("--in-jsonl", help="comma-separated patterns; each file is a load of its own")
    source.add_argument("--db")
    build.add_argument("--table", default="latest_news")
    build.add_argument("--out", required=True)
    build.add_argument("--target-chars", type=int, default=1000)
    build.add_argument("--overlap", type=int, default=150)
    build.add_argument("--no-embed", action="store_true")
    build.add_argument("--no-full-text", action="store_true")
    build.add_argument("--site-slug")
    build.add_argument("--rebuild", action="store_true")
    inspect = commands.add_parser("inspect", help="a look at a vector table")
    inspect.add_argument("path")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    if args.command == "inspect":
        pipeline.inspect(spark.read.parquet(args.path)).show(truncate=60)
        return
    if args.command == "ingest":
        files = args.files or [f for f in [only_file("data")] if f]
        if not files:
            raise SystemExit("name a file, or leave exactly one readable file in ./data")
        print(json.dumps({"rows": pipeline.ingest(spark, files, args.out, reset=args.reset)}))
        return
    loads = [(None, lambda: read_news_table(spark, args.db, args.table))] if args.db else [(p, lambda p=p: normalized(read_json_lines(spark, [p]))) for p in expand(args.in_jsonl)]
    for n, (path, load) in enumerate(loads):
        slug = args.site_slug or (path.rsplit("/", 1)[-1].rsplit(".", 1)[0] if path else None)
        cfg = PipelineConfig(args.out, args.target_chars, args.overlap, not args.no_embed, not args.no_full_text, args.rebuild and n == 0, slug)
        print(json.dumps({"source": path or args.db, **pipeline.run_pipeline(load(), cfg)}, ensure_ascii=False))


if __name__ == "__main__":
    main()

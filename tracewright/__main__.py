"""``python -m tracewright index`` and ``python -m tracewright packet``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.packet import as_json
from .plans.index import EvidenceIndex, default_index_path
from .sources.rollouts import default_sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build or refresh the index")
    i.add_argument("--db")
    i.add_argument("--source", action="append", default=[])
    i.add_argument("--rebuild", action="store_true")
    i.add_argument("--format", choices=["text", "markdown", "json"], default="text")
    q = sub.add_parser("packet", help="cited evidence for a question")
    q.add_argument("query")
    q.add_argument("--db")
    q.add_argument("--sessions", type=int, default=5)
    q.add_argument("--evidence", type=int, default=12)
    q.add_argument("--context", type=int, default=1)
    q.add_argument("--format", choices=["text", "markdown", "json"], default="markdown")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tracewright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    db = args.db or default_index_path()
    try:
        index = EvidenceIndex(spark, db)
        if args.command == "index":
            stats = (index.rebuild if args.rebuild else index.refresh)(args.source or default_sources())
            print(stats.json() if args.format == "json" else stats.text(db))
            return 0
        options = {"max_sessions": args.sessions, "max_evidence": args.evidence, "context": args.context}
        print(as_json(index.ask(args.query, **options)) if args.format == "json" else index.ask_markdown(args.query, **options), end="\n" if args.format == "json" else "")
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

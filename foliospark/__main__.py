"""Command line: python -m foliospark ingest|inspect|list|summary|export|graph-status|doctor …"""

from __future__ import annotations

import argparse
import importlib.metadata
import json
import os
import shutil
import sys

from pyspark.sql import SparkSession

from foliospark import engine, settings
from foliospark.operators import graph


def doctor() -> dict[str, dict[str, str | None]]:
    """Versions of what is needed, and where the optional tools are."""
    found: dict[str, str | None] = {}
    for name in ("pyspark", "pyarrow", "numpy", "pandas"):
        try:
            found[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            found[name] = None
    return {"python": {"version": ".".join(map(str, sys.version_info[:3]))}, "packages": found, "tools": {t: shutil.which(t) for t in ("java", "soffice", "ffmpeg", "exiftool")}}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliospark")
    todo = parser.add_subparsers(dest="command", required=True)
    add = todo.add_parser("ingest", help="bring files into a collection")
    add.add_argument("paths", nargs="+")
    add.add_argument("--out", required=True)
    add.add_argument("--settings", type=json.loads, default={})
    add.add_argument("--acknowledge-large", action="store_true")
    add.add_argument("--force", action="store_true")
    todo.add_parser("inspect", help="what is known of files before any work").add_argument("paths", nargs="+")
    todo.add_parser("list", help="collections below a folder").add_argument("root")
    todo.add_parser("summary", help="totals of a collection").add_argument("folder")
    todo.add_parser("graph-status", help="what a graph holds").add_argument("folder")
    todo.add_parser("doctor", help="what this machine has")
    export = todo.add_parser("export", help="write Markdown, chunk records and a guide")
    export.add_argument("folder")
    export.add_argument("--to", required=True)
    given = parser.parse_args(arguments)
    if given.command == "doctor":
        print(json.dumps(doctor(), indent=1))
        return 0
    if given.command == "graph-status":
        print(json.dumps(graph.status(given.folder)))
        return 0
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    if given.command == "ingest":
        try:
            made = engine.ingest(spark, given.paths, given.out, settings.load({}, None, os.environ, given.settings), given.acknowledge_large, given.force)
        except engine.BudgetExceeded as e:
            print(f"refused: {e}")
            return 2
        print(json.dumps(made.summary(), default=str))
    elif given.command == "inspect":
        engine.inspect(spark, given.paths).select("path", "format", "size_mb", "pages", "est_cost_usd", "recommendation").show(1000, False)
    elif given.command == "list":
        for c in engine.collections(spark, given.root):
            print(c.folder, c.run)
    elif given.command == "summary":
        print(json.dumps(engine.Collection(spark, given.folder).summary(), default=str))
    else:
        engine.Collection(spark, given.folder).export(given.to)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m lorespark list | run QUERY FOLDER [OUTPUT]: the queries over a folder of tables, shown or written as Parquet."""

from __future__ import annotations

import argparse
import sys


def main(arguments: list[str] | None = None) -> int:
    from lorespark.plans import registry

    parser = argparse.ArgumentParser(prog="lorespark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("output", nargs="?")
    asked = parser.parse_args(arguments)
    if asked.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if asked.query not in registry.QUERIES:
        print(f"no query {asked.query}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    df = registry.QUERIES[asked.query](SparkSession.builder.getOrCreate(), asked.folder)
    df.write.mode("overwrite").parquet(asked.output) if asked.output else df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

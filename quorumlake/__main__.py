"""``python -m quorumlake list | sql NAME | run NAME --dir TABLES [--out FOLDER]``: the queries from a command line."""

from __future__ import annotations

import argparse
import sys

from quorumlake import plans


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quorumlake", description=__doc__)
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list", help="names of the queries, those with SQL marked")
    for name in ("sql", "run"):
        todo.add_parser(name).add_argument("query", choices=sorted(plans.queries()))
    run = todo.choices["run"]
    run.add_argument("--dir", required=True, help="folder of the Parquet tables")
    run.add_argument("--out", help="folder for the result as Parquet; without it, its first rows are shown")
    given = parser.parse_args(arguments)
    if given.todo == "list":
        print("\n".join(f"{n}{' (SQL)' if n in plans.oracle_sql() else ''}" for n in sorted(plans.queries())))
    elif given.todo == "sql":
        if given.query not in plans.oracle_sql():
            print(f"{given.query} has no SQL", file=sys.stderr)
            return 1
        print(plans.oracle_sql()[given.query])
    else:
        from pyspark.sql import SparkSession

        result = plans.queries()[given.query](SparkSession.builder.getOrCreate(), given.dir)
        if given.out:
            result.write.parquet(given.out)
        else:
            result.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

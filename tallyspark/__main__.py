"""python -m tallyspark --list | QUERY TABLES_DIR OUTPUT: write a registered query's rows as Parquet."""

from __future__ import annotations

import argparse

from .plans import registry
from .session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    parser.add_argument("query", nargs="?", choices=sorted(registry.QUERIES), metavar="QUERY")
    parser.add_argument("tables", nargs="?", metavar="TABLES_DIR")
    parser.add_argument("output", nargs="?", metavar="OUTPUT")
    parser.add_argument("--list", action="store_true", help="name the queries and what they are")
    parser.add_argument("--explain", action="store_true", help="print the plan instead of running")
    given = parser.parse_args(argv)
    if given.list:
        for name, query in sorted(registry.QUERIES.items()):
            print(f"{name}: {(query.__doc__ or '').strip().splitlines()[0] if query.__doc__ else ''}")
        return 0
    if not given.query or not given.tables or not (given.output or given.explain):
        parser.error("a query, a folder of tables and an output are needed")
    rows = registry.QUERIES[given.query](session(), given.tables)
    if given.explain:
        rows.explain("formatted")
    else:
        rows.write.mode("errorifexists").parquet(given.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Commands over a table folder: ``python -m paneltide.cli <query> <folder>`` prints a query's rows, ``list`` names them all."""

from __future__ import annotations

import argparse

from paneltide.plans import catalogue
from paneltide.session import build


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="paneltide")
    parser.add_argument("query", help="a query's name, or list")
    parser.add_argument("folder", nargs="?", help="folder with the Parquet tables")
    parser.add_argument("--out", help="write Parquet there instead of printing")
    parser.add_argument("--limit", type=int, default=20, help="rows to print")
    parser.add_argument("--master", default="local[*]")
    given = parser.parse_args(args)
    queries = catalogue.queries()
    if given.query == "list":
        print("\n".join(sorted(queries)))
        return 0
    if given.query not in queries or not given.folder:
        parser.error(f"unknown query {given.query!r}" if given.query not in queries else "a folder is needed")
    df = queries[given.query](build(given.master), given.folder)
    df.write.mode("errorifexists").parquet(given.out) if given.out else df.show(given.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

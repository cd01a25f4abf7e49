"""Run a registered query: python -m cairn QUERY TABLES [--out FOLDER] [--explain]; --list names them all."""

from __future__ import annotations

import argparse
import sys

from cairn.plans import registry
from cairn.session import get_session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    p.add_argument("query", nargs="?")
    p.add_argument("tables", nargs="?", help="folder of the input tables")
    p.add_argument("--out", help="write the result there as Parquet; else twenty rows are shown")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--list", action="store_true")
    a = p.parse_args(args)
    if a.list:
        print("\n".join(sorted(registry.queries())))
        return 0
    if not a.query or not a.tables or a.query not in registry.queries():
        p.print_usage(sys.stderr)
        return 2
    df = registry.queries()[a.query](get_session(), a.tables)
    if a.explain:
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

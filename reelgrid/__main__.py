"""Command line: load archives, search, and show titles and persons.

    python -m reelgrid load ARCHIVES CATALOGUE [--cleanup]
    python -m reelgrid sample ARCHIVES OUT (--lines N | --percent P | --head N)
    python -m reelgrid --uri CATALOGUE search {title,person} TEXT [-n N] [--first]
    python -m reelgrid --uri CATALOGUE get {title,person} ID
"""

from __future__ import annotations

import argparse
import sys

from reelgrid.errors import ReelgridError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reelgrid")
    p.add_argument("--uri", help="folder of the stored catalogue")
    commands = p.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load")
    load.add_argument("archives")
    load.add_argument("catalogue")
    load.add_argument("--cleanup", action="store_true", help="remove the archives after success")
    cut = commands.add_parser("sample")
    cut.add_argument("archives")
    cut.add_argument("out")
    size = cut.add_mutually_exclusive_group(required=True)
    for flag in ("--lines", "--percent", "--head"):
        size.add_argument(flag, type=int)
    find = commands.add_parser("search")
    find.add_argument("kind", choices=("title", "person"))
    find.add_argument("text")
    find.add_argument("-n", type=int, default=20)
    find.add_argument("--first", action="store_true")
    get = commands.add_parser("get")
    get.add_argument("kind", choices=("title", "person"))
    get.add_argument("id")
    return p


def listing(rows: list, key: str, shown: str) -> list[str]:
    """A numbered list with ids of one width."""
    width = max((len(str(r[key])) for r in rows), default=0)
    return [f"{r['rank']:>3}  {str(r[key]).rjust(width)}  {r[shown]}" for r in rows]


def main(argv: list[str] | None = None, spark=None) -> int:  # noqa: ANN001
    args = parser().parse_args(argv)
    if args.command in ("search", "get") and not args.uri:
        print("--uri is needed", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("reelgrid").getOrCreate()
    from reelgrid.catalog import Catalog
    from reelgrid.sources import archives

    try:
        if args.command == "load":
            print(archives.load(spark, args.archives, args.catalogue, args.cleanup)["status"])
        elif args.command == "sample":
            kept = archives.sample(spark, args.archives, args.out, args.lines or args.head, args.percent, tail=not args.head)
            print("\n".join(f"{k}\t{v}" for k, v in kept.items()))
        elif args.command == "get":
            record = getattr(Catalog.open(spark, args.uri), args.kind)(args.id)
            print("\n".join(f"{k}: {v}" for k, v in record.items()))
        else:
            catalog = Catalog.open(spark, args.uri)
            found = (catalog.search_titles if args.kind == "title" else catalog.search_people)(args.text, results=1 if args.first else args.n)
            key, shown = ("tconst", "title") if args.kind == "title" else ("nconst", "name")
            print("\n".join(listing(found.orderBy("rank").collect(), key, shown)))
    except ReelgridError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

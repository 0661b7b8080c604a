"""Command line of the background catalog: list, check, update and download."""

from __future__ import annotations

import argparse
import sys

from .sources.catalog import Catalog


def main(args: list[str] | None = None) -> int:
    """Exit 2 for wrong usage, 1 for an error or outdated tables, 0 otherwise."""
    parser = argparse.ArgumentParser(prog="textassay-background", description=__doc__)
    parser.add_argument("codes", nargs="*", help="languages to download")
    parser.add_argument("--manifest", required=True, help="address of the manifest")
    parser.add_argument("--to", default="backgrounds", help="folder of the tables")
    parser.add_argument("--list", action="store_true", help="show the languages published")
    parser.add_argument("--check", action="store_true", help="show tables that the release has changed")
    parser.add_argument("--update", action="store_true", help="download changed tables again")
    given = parser.parse_args(args)
    if not (given.list or given.check or given.update or given.codes):
        parser.print_usage(sys.stderr)
        return 2
    try:
        catalog = Catalog(given.manifest)
        if given.list:
            sentences = catalog.sentences()
            for code, name in catalog.available().items():
                print(f"{code}\t{name}\t{sentences[code]}")
        elif given.check:
            found = catalog.outdated(given.to)
            for code, state in found.items():
                print(f"{code}\t{state}")
            return 1 if found else 0
        else:
            for path in catalog.update(given.to) if given.update else catalog.download(given.codes, given.to):
                print(path)
    except (RuntimeError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

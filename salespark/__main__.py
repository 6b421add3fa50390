"""Command line: list, show or explain the registered queries.

    python -m salespark list
    python -m salespark show  <query> [sf_dir] [rows]
    python -m salespark explain <query> [sf_dir]
"""

from __future__ import annotations

import sys

from .plans import registry
from .plans.session import build_session

DEFAULT_DIR = "/root/testdata/sf0.01"


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in ("list", "show", "explain"):
        print(__doc__)
        return 2
    if argv[0] == "list":
        for key in sorted(registry.QUERIES):
            print(key, "" if key in registry.ORACLE else "(no SQL oracle)")
        return 0
    key = argv[1]
    sf_dir = argv[2] if len(argv) > 2 else DEFAULT_DIR
    spark = build_session()
    df = registry.QUERIES[key](spark, sf_dir)
    if argv[0] == "show":
        df.show(int(argv[3]) if len(argv) > 3 else 20, truncate=False)
    else:
        df.explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

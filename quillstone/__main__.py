"""Command line: list registered queries, or run one over a folder of tables and show or write its rows.

python -m quillstone                     names
python -m quillstone NAME FOLDER         first rows
python -m quillstone NAME FOLDER OUT     rows as Parquet
"""

from __future__ import annotations

import sys

from .plans import catalog
from .session import local_session


def main(args: list[str]) -> int:
    if not args:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if args[0] not in catalog.QUERIES or len(args) not in (2, 3):
        print(__doc__, file=sys.stderr)
        return 2
    df = catalog.QUERIES[args[0]](local_session(), args[1])
    df.write.mode("overwrite").parquet(args[2]) if len(args) == 3 else df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""python -m embermill [NAME DIRECTORY [OUT]]: lists the registered queries, or runs one over a data directory and
shows its first rows, or writes them all to OUT."""

from __future__ import annotations

import importlib
import sys


def main(args: list[str]) -> int:
    from embermill.plans.registry import registry

    for name in ("data_quality", "statistics", "film", "library", "records"):
        importlib.import_module(f"embermill.plans.{name}")
    if not args:
        print("\n".join(registry.queries))
        return 0
    if len(args) not in (2, 3) or args[0] not in registry.queries:
        print(__doc__, file=sys.stderr)
        return 2
    from embermill.session import get_session

    df = registry.queries[args[0]](get_session(), args[1])
    if len(args) == 3:
        df.write.mode("errorifexists").parquet(args[2])
    else:
        df.show(20, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

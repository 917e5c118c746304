"""Command line form of the oracle check: python -m tests.run_oracles [sf] [name prefix ...]"""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry
from rankforge.session import local_session
from tests.oracle import compare, connect


def main() -> int:
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session(8), connect(sf)
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                ok, message = compare(query(spark, sf), con, oracles[name])
            else:
                n = query(spark, sf).count()
                ok, message = n > 0, f"{n} rows, no oracle"
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {message}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())

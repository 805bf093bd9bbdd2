"""Compare every registered query with its SQL: ``python tests/check_all.py [dir] [name ..]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duskline.plans import load
from duskline.session import local_session
from tests.oracle import compare, connect


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    queries, oracles = load()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                diff = compare(df, con, oracles[name])
            else:
                n = df.count()
                diff = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.2f}s {diff or ''}", flush=True)
    print(f"{bad} bad of {len(names or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)

"""Compare registered queries with their SQL: python tests/check.py [sf] [name part ...]."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402

from armature.catalog import QUERIES, SQL  # noqa: E402
from armature.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = []
    for name in sorted(QUERIES):
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in SQL:
                problem = oracle.compare(df, con, SQL[name])
                note = problem or "ok"
            else:
                names, rows = oracle.spark_rows(df)
                problem = None if rows else "no rows"
                note = f"rows only: {len(rows)}"
        except Exception as e:  # noqa: BLE001
            problem = note = f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in parts:
                traceback.print_exc()
        if problem:
            bad.append(name)
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())

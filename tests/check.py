"""Command line: compare queries with their oracles. ``python -m tests.check SF [name ...]``"""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as entry
from branchtally.session import local_session
from tests.oracle import connect, difference


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.perf_counter()
        try:
            df = queries[name](spark, sf_dir)
            problem = difference(df, con, oracles[name]) if name in oracles else f"rows {df.count()}"
        except Exception:
            problem = traceback.format_exc(limit=-3)[-1500:]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.perf_counter() - start:.2f}s", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)

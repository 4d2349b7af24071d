"""python tests/check.py [sf_dir] [name ...]: compare registered queries with their SQL twins."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import twins
from visilake.registry import registered
from visilake.session import local_session

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = twins.connect(sf_dir)
    bad = 0
    for name, (build, sql) in registered().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if sql is None:
                print(f"rows  {name}: {build(spark, sf_dir).count()} ({time.time() - t:.1f}s)", flush=True)
                continue
            n, m, diff = twins.compare(spark, con, sf_dir, build, sql)
            ok = n == m and not diff
            bad += not ok
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {n} / {m} ({time.time() - t:.1f}s)", *[str(d)[:600] for d in diff], sep="\n      " if diff else "", flush=True)
        except Exception as problem:
            bad += 1
            print(f"FAIL  {name}: {type(problem).__name__} {str(problem)[:900]}", flush=True)
    print("bad:", bad)

"""Run every query at $SF against its SQL: python tests/check.py [name ...]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import compare, connect
from playbill.session import local_session

folder = f"/root/testdata/sf{os.environ.get('SF', '0.01')}"
spark = local_session("8", "check")
con = connect(folder)
queries, sqls = entry.queries(), entry.oracle_sql()
names = [n for n in queries if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
bad = []
for name in names:
    start = time.time()
    try:
        if name in sqls:
            n, diff = compare(spark, con, folder, queries[name], sqls[name])
        else:
            n, diff = queries[name](spark, folder).count(), []
    except Exception as e:
        n, diff = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
    mark = "ok  " if not diff else "FAIL"
    print(f"{mark} {name:28s} rows={n:<8d} {time.time() - start:6.2f}s {'' if name in sqls else '(no sql)'}", flush=True)
    for line in diff:
        print("     ", line[:900], flush=True)
    if diff or n == 0:
        bad.append(name)
print(f"{len(names)} queries, {len(bad)} failed or empty: {bad}")

"""python tests/check.py [prefix ...]: compare queries with their SQL at sf0.01."""

import os
import signal
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from cadenza.session import local_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def late(*_):
    raise TimeoutError("query took too long")


def main():
    signal.signal(signal.SIGALRM, late)
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("check")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    want = sys.argv[1:]
    bad = 0
    for name, fn in queries.items():
        if want and not any(name == w or name.startswith(w) for w in want):
            continue
        t = time.time()
        signal.alarm(int(os.environ.get("EACH", "60")))
        try:
            df = fn(spark, sf)
            if name in oracles:
                why = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                why = None if n else "empty"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:900]}"
        signal.alarm(0)
        tag = "ok  " if why is None else "FAIL"
        bad += why is not None
        print(f"{tag} {name} {time.time() - t:.1f}s {'' if name in oracles else '(rows only)'} {why or ''}", flush=True)
    print("failures:", bad)


main()

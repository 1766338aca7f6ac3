"""Compare registered queries with their SQL: check.py [-s SF] [-r HOTROWS] [name-prefix ...]"""

import argparse
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
from tests.compare import compare, duck  # noqa: E402


def main():
    p = argparse.ArgumentParser()
    p.add_argument("-s", default="0.01")
    p.add_argument("-r", default=None)
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    from fitlake.queries import registry
    from fitlake.session import local_session
    sf_dir = f"/root/testdata/sf{a.s}"
    if a.names and a.names[0].startswith("@"):
        registry.MODULES = tuple(n[1:] for n in a.names)
        a.names = []
    registry.load_all()
    spark = local_session()
    if a.r:
        spark.conf.set("spark.fitlake.chunkRows", a.r)
    con = duck(sf_dir)
    fails = 0
    for name, build in registry.QUERIES.items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        t = time.time()
        try:
            df = build(spark, sf_dir)
            if name in registry.SQL:
                msg = compare(df, con, registry.SQL[name])
            else:
                n = len(df.collect())
                msg = None if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        fails += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {time.time() - t:6.2f}s {name}"
              + (f"\n     {msg}" if msg else ""), flush=True)
    print("failures:", fails)


main()

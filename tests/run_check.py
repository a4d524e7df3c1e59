"""python tests/run_check.py [sf_dir] [name ...]: compare queries with their SQL and print timings."""

from __future__ import annotations

import sys
import time
import traceback

sys.path[:0] = [".", "tests"]

from compare import difference, duck  # noqa: E402

from pathlore.plans import FAMILIES, registry  # noqa: E402
from pathlore.session import build_session  # noqa: E402

if __name__ == "__main__":
    from importlib import import_module

    sf, names = sys.argv[1], sys.argv[2:]
    for family in FAMILIES:
        try:
            import_module(f"pathlore.plans.{family}_queries")
        except ModuleNotFoundError as e:
            print("no module", e)
    families = [n for n in names if n in FAMILIES]
    names = [n for n in names if n not in FAMILIES]
    for n, fn in registry.QUERIES.items():
        if any(fn.__module__.endswith(f".{f}_queries") for f in families):
            names.append(n)
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in names or list(registry.QUERIES):
        start = time.time()
        try:
            got = registry.QUERIES[name](spark, sf).toPandas()
            took = time.time() - start
            sql = registry.SQL.get(name)
            verdict = "rows-only" if sql is None else difference(got, con.sql(sql).df()) or "ok"
            print(f"{name:34s} {len(got):8d} {took:6.2f}s {verdict}", flush=True)
            if verdict == "rows-only":
                print(got.head(4).to_string())
            bad += verdict not in ("ok", "rows-only")
        except Exception as e:
            bad += 1
            print(f"{name:34s} FAIL {type(e).__name__}: {str(e)[:600]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("bad:", bad)

"""Run registered queries against their SQL in DuckDB. Usage: check_oracles.py SF_DIR [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from spoorgrid.plans.bindings import BASE_TABLES  # noqa: E402
from spoorgrid.plans.catalog import REGISTRY  # noqa: E402
from spoorgrid.session import local_session  # noqa: E402

SPARK_ONLY = os.environ.get("SPARK_ONLY") == "1"


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = []
    for name, q in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = q.build(spark, sf_dir)
            cols = sorted(df.columns)
            got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
            took = time.time() - start
            if q.sql is None or SPARK_ONLY:
                print(f"rows  {name:45s} {len(got):8d} {took:6.2f}s", flush=True)
                continue
            start = time.time()
            rel = con.execute(q.sql)
            names = [d[0] for d in rel.description]
            order = [names.index(c) for c in cols] if sorted(names) == cols else None
            want = sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall()) if order else None
            duck = time.time() - start
            if want == got:
                print(f"ok    {name:45s} {len(got):8d} {took:6.2f}s duck {duck:5.2f}s", flush=True)
                continue
            bad.append(name)
            print(f"DIFF  {name:45s} spark {len(got)} duck {None if want is None else len(want)}", flush=True)
            if want is None:
                print("   columns", cols, sorted(names))
            else:
                a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
                print("   cols", cols, "\n   only spark", len(a), a[:3], "\n   only duck ", len(b), b[:3])
        except Exception as err:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL  {name}: {type(err).__name__} {str(err)[:900]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

"""Run registered queries against their SQL twins: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def same(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return type(a) is type(b) and a == b or (a is None and b is None)


def exact_hash(columns, rows) -> int:
    """Bit-exact comparison value, to see which queries need a tolerance."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return hash(frozenset((tuple(repr(r[i]) for i in order)) for r in rows))


def check(spark, con, sf, name, build, sql):
    t0 = time.time()
    df = build(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return ("ROWS", len(rows), spent, "")
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    if sorted(df.columns) != sorted(dcols):
        return ("COLS", len(rows), spent, f"{sorted(df.columns)} != {sorted(dcols)}")
    if len(rows) != len(drows):
        return ("COUNT", len(rows), spent, f"{len(rows)} != {len(drows)}")
    cols, a = canon(df.columns, rows)
    _, b = canon(dcols, drows)
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    if bad:
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if not same(p, q)]
        return ("VALUES", len(rows), spent, f"{len(bad)} rows differ, first: {diff[:4]}")
    exact = "" if exact_hash(df.columns, rows) == exact_hash(dcols, drows) else "~"
    return ("OK" + exact, len(rows), spent, "")


def main(argv):
    import __spark_entry__ as e
    from fleetspan.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(**{"spark.ui.showConsoleProgress": "false"})
    con, sqls = duck(sf), e.oracle_sql()
    bad = 0
    for name, build in e.queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            state, n, spent, note = check(spark, con, sf, name, build, sqls.get(name))
        except Exception as err:  # report and go on
            state, n, spent, note = "ERROR", 0, 0.0, str(err).replace("\n", " ")[:600]
        bad += state.rstrip("~") not in ("OK", "ROWS")
        print(f"{state:7} {name:32} {n:7d} rows {spent:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

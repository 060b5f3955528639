"""Compares registered queries with their DuckDB twins over one directory: python tests/compare.py DIR [NAME...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x

    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(directory):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(directory)):
        if f.endswith(".parquet"):
            p = os.path.join(directory, f)
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def differing(spark, directory, names, say=print):
    import __spark_entry__ as entry

    sql, con, bad = entry.oracle_sql(), duck(directory), []
    for name in names:
        t = time.time()
        try:
            df = entry.queries()[name](spark, directory)
            got = rows_of(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001  (one failing query must not hide the others)
            bad.append(name)
            say(f"FAILS {name}: {type(e).__name__} {str(e)[:600]}")
            continue
        took = time.time() - t
        if name not in sql:
            say(f"rows {name}: {len(got[1])} in {took:.1f} s")
            continue
        try:
            r = con.execute(sql[name])
            want = rows_of([c[0] for c in r.description], r.fetchall())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            say(f"FAILS {name} in DuckDB: {str(e)[:600]}")
            continue
        if got != want:
            bad.append(name)
            a, b = set(map(repr, got[1])), set(map(repr, want[1]))
            say(f"DIFFERS {name}: {got[0]} {len(got[1])} / {want[0]} {len(want[1])}; only Spark {sorted(a - b)[:3]}; only DuckDB {sorted(b - a)[:3]}")
        else:
            say(f"equal {name}: {len(got[1])} in {took:.1f} s")
    return bad


if __name__ == "__main__":
    import __spark_entry__ as entry

    from platlens.plans.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(entry.queries())
    sys.exit(bool(differing(spark, sys.argv[1], names)))

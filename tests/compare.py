"""Compare registered queries with their SQL in DuckDB: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(round(value, 9) + 0.0))
    if isinstance(value, bool) or value is None:
        return ("b", str(value))
    if isinstance(value, int):
        return ("i", str(value))
    if hasattr(value, "isoformat"):
        return ("t", value.isoformat())
    return ("s", str(value))


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def difference(spark, con, query, sql: str, folder: str) -> str | None:
    """None if both sides agree in column names and rows."""
    df = query(spark, folder)
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} rows against {len(theirs)}; here alone: {sorted(a)[:2]}; there alone: {sorted(b)[:2]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tessera.session import session

    spark = session(f"local[{os.environ.get('COMPARE_CPUS', '8')}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    folder, chosen = sys.argv[1], sys.argv[2:]
    con, queries, oracles, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    for name in chosen or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            said = difference(spark, con, queries[name], oracles[name], folder) if name in oracles else f"{queries[name](spark, folder).count()} rows, no SQL"
        except Exception:
            said = "ERROR " + " | ".join(x for x in traceback.format_exc().splitlines() if x.strip() and not x.startswith((" ", "\t")))[-400:]
        if said and not said.endswith("no SQL"):
            bad += 1
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print("differences:", bad)

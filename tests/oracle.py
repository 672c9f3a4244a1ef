"""Run registered queries against DuckDB. ``python tests/oracle.py sf0.01 [name ...]``"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    out = [tuple(_plain(row[j]) for j in order) for row in rows]
    return [columns[j] for j in order], sorted(out, key=lambda t: tuple((x is None, type(x).__name__, x if x is not None else 0) for x in t))


def compare(spark, con, sf_dir, query, sql) -> tuple[int, list[str]]:
    df = query(spark, str(sf_dir))
    got_cols, got = _sorted_rows(df.columns, [tuple(x) for x in df.collect()])
    rel = con.execute(sql)
    want_cols, want = _sorted_rows([c[0] for c in rel.description], rel.fetchall())
    problems = []
    if got_cols != want_cols:
        problems.append(f"columns: only here {set(got_cols) - set(want_cols)}, only in SQL {set(want_cols) - set(got_cols)}")
        return len(got), problems
    if len(got) != len(want):
        problems.append(f"rows: {len(got)} here, {len(want)} in SQL")
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b or type(a) is not type(b)]
        problems.append(f"{len(bad)} rows differ, first: {diff[:6]} in {g[:6]}")
    return len(got), problems


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from lagwise.session import local_session

    spark = local_session(cores=8, shuffle_partitions=8)
    con = connect(DATA / sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in sqls:
                n, problems = compare(spark, con, DATA / sf, queries[name], sqls[name])
            else:
                n, problems = queries[name](spark, str(DATA / sf)).count(), []
        except Exception as e:  # noqa: BLE001
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:900]}"]
        failed += bool(problems)
        kind = "sql" if name in sqls else "rows only"
        print(f"{'FAIL' if problems else 'ok':4} {name:32} {n:8} rows {time.time() - start:6.2f}s {kind}", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "sf0.01", sys.argv[2:])))

"""Spark-vs-DuckDB comparison used by the tests and by ``python -m tests.oracle``.

Both results go through Arrow so decimals stay decimals; values are compared
as sorted multisets of rows (order-insensitive), after checking the column
names and the row count.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(table) -> tuple[list[str], list[tuple]]:
    cols = table.column_names
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    data = table.to_pylist()
    rows = sorted(tuple(_norm(r[cols[i]]) for i in order) for r in data)
    return [cols[i] for i in order], rows


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    sdf = E.queries()[name](spark, sf_dir)
    sql = E.oracle_sql().get(name)
    s_cols, s_rows = rows_of(sdf.toArrow())
    if sql is None:
        return True, f"{name}: no oracle, {len(s_rows)} rows"
    con = con or duck_connect(sf_dir)
    res = con.sql(sql).arrow()
    d_cols, d_rows = rows_of(res.read_all() if hasattr(res, "read_all") else res)
    if s_cols != d_cols:
        return False, f"{name}: columns differ spark={s_cols} duck={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"{name}: row count spark={len(s_rows)} duck={len(d_rows)}"
    if s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        return False, f"{name}: values differ, first: {diff}"
    return True, f"{name}: ok {len(s_rows)} rows"


def _norm_pandas(v):
    import pandas as pd

    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (decimal.Decimal, float, int)):
        return round(float(v), 6)
    if isinstance(v, (pd.Timestamp, dt.datetime, dt.date)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def compare_pandas(spark, name: str, sf_dir: str, con=None, spark_pdf=None) -> tuple[bool, str]:
    """The same check through pandas (Spark ``toPandas`` vs DuckDB ``df``),
    where decimals, nullable integers and dates arrive with different
    dtypes: values are compared null-aware, numbers as floats."""
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    s = spark_pdf if spark_pdf is not None else E.queries()[name](spark, sf_dir).toPandas()
    con = con or duck_connect(sf_dir)
    d = con.sql(E.oracle_sql()[name]).df()
    s, d = s[sorted(s.columns)], d[sorted(d.columns)]
    if list(s.columns) != list(d.columns):
        return False, f"{name}: columns differ"
    rows = lambda f: sorted((tuple(_norm_pandas(x) for x in r) for r in f.itertuples(index=False)), key=repr)  # noqa
    rs, rd = rows(s), rows(d)
    if rs != rd:
        return False, f"{name}: values differ, first: {[(a, b) for a, b in zip(rs, rd) if a != b][:2]}"
    return True, f"{name}: ok {len(rs)} rows"


def main(argv):
    """``python -m tests.oracle [--pandas] [sf_dir] [query ...]``"""
    argv = list(argv)
    check = compare
    if "--pandas" in argv:
        argv.remove("--pandas")
        check = compare_pandas
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    sys.path.insert(0, "/root/repo")
    from campaignlab.session import local_session
    import __spark_entry__ as E

    spark = local_session()
    con = duck_connect(sf_dir)
    names = names or list(E.queries())
    bad = 0
    for n in names:
        try:
            ok, msg = check(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

"""Runs registered queries next to their reference SQL and compares every value and type."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry_point
from workload.fixtures import TABLES

TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR",
    "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = entry_point.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(got)}"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = dict(zip(names, types, strict=True))
    odd = [
        f"{c} {t} {theirs[c]}" for c, t in df.dtypes
        if TYPES.get(t, t) != theirs[c] and theirs[c] != "NULL" and '"NULL"' not in theirs[c]
    ]
    mine, other = rows_of(df.columns, got), rows_of(names, want)
    if mine != other:
        diff = next(((a, b) for a, b in zip(mine, other, strict=False) if a != b), ("", ""))
        return False, f"{len(mine)} rows against {len(other)}; {sorted(names)}; first difference\n   {diff[0]!r}\n   {diff[1]!r}"
    if not mine:
        return False, "no rows"
    return not odd, f"{len(mine)} rows" + (f"; types differ: {odd}" if odd else "")


def main(sf: str, only: list[str]) -> int:
    from bench import session

    import logging

    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    spark = session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in entry_point.queries():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)

"""Compare a registered query with its SQL, as bags of rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, query, sql: str, folder: str = DATA) -> bool:
    frame = query(spark, folder)
    got = bag(frame.columns, frame.collect())
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    want = bag([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert not (got[1] - want[1]) and not (want[1] - got[1]), (list((got[1] - want[1]))[:2], list((want[1] - got[1]))[:2])
    return bool(got[1])

"""Compare Spark results with DuckDB results on the same parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def spark_table(df):
    return _table(df.columns, [tuple(r) for r in df.collect()]), {f.name: f.dataType.simpleString() for f in df.schema.fields}


def duck_table(con, sql):
    cur = con.execute(sql)
    desc = cur.description
    return _table([d[0] for d in desc], cur.fetchall()), {d[0]: str(d[1]) for d in desc}


SAME = {
    "string": {"VARCHAR"}, "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"},
}


def mismatch(df, con, sql) -> str | None:
    (sc, sr), st = spark_table(df)
    (dc, dr), dt = duck_table(con, sql)
    if sc != dc:
        return f"columns {sc} vs {dc}"
    odd = [(c, st[c], dt[c]) for c in sc if dt[c] not in SAME.get(st[c], {dt[c]})]
    if odd:
        return f"types {odd}"
    if len(sr) != len(dr):
        a, b = set(map(repr, sr)), set(map(repr, dr))
        return f"rows {len(sr)} vs {len(dr)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    for a, b in zip(sr, dr):
        if a != b:
            return f"value {a} vs {b}"
    return None

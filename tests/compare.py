"""Rows of a DataFrame and of a DuckDB query in one canonical form."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    return str(v)


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def views(con, sf_dir):
    for t in TABLES:
        con.execute(f"create or replace view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(df, con, sql):
    found = con.execute(sql)
    want = canonical_rows([d[0] for d in found.description], found.fetchall())
    got = canonical_rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want

"""Rows of a query and of its SQL, in a form that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([norm(x) for x in v]) if isinstance(v, list) else str(v)


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    ours = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    theirs = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    return ours, theirs

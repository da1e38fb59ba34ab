"""Comparison of a query's rows with those of its SQL on DuckDB: same columns by name, same rows in any order."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def same(spark, query, sql, sf_dir):
    ours = query(spark, sf_dir)
    theirs = connect(sf_dir).execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    a, b = rows(ours.columns, ours.collect()), rows(names, theirs.fetchall())
    assert len(a) == len(b)
    assert a == b, [x for x in a if x not in set(b)][:3] + [x for x in b if x not in set(a)][:3]

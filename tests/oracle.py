"""Compare a query's rows with those of its DuckDB SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same_rows(df, c, sql) -> None:
    found = c.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    ours = sorted(tuple(str(r[x]) for x in columns) for r in df.collect())
    places = [found.columns.index(x) for x in columns]
    theirs = sorted(tuple(str(r[i]) for i in places) for r in found.fetchall())
    assert ours == theirs

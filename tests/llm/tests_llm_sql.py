"""Rows of a query against the rows of its SQL on the same tables."""

import duckdb

TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "embeddings"]


def rows(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(*names).toPandas().astype(object).values.tolist()))


def sql_rows(sql, sf_dir=None, tables=None):
    con = duckdb.connect()
    for t in TABLES if sf_dir else []:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, table in (tables or {}).items():
        con.register(name, table)
    out = con.execute(sql).fetch_df()
    return sorted(map(repr, out[sorted(out.columns)].astype(object).values.tolist()))

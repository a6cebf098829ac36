"""Runs a query and its SQL on the same rows and compares the results."""

import duckdb


def rows(result):
    return sorted((tuple(r[c] for c in sorted(r)) for r in result), key=repr)


def same(spark, query, sql, tables, tmp_path):
    """tables: name -> DataFrame; each is written as Parquet, then read by both engines."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = rows(r.asDict() for r in query(spark, str(tmp_path)).collect())
    rel = con.sql(sql)
    want = rows(dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())
    assert got == want
    return got

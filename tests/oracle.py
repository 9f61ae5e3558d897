"""Shared Spark-vs-DuckDB comparison used by the tests."""

from tools.oracle_check import duck, duck_types, rows_of, spark_types


def compare(spark, sf_dir, name, qfn, sql):
    df = qfn(spark, sf_dir)
    srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    rel = con.sql(sql)
    dtypes = duck_types(rel)
    drows = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), name
    assert spark_types(df) == dtypes, name
    assert len(srows) == len(drows), (name, len(srows), len(drows))
    assert srows == drows, name
    return len(srows)


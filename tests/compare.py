"""Runs a query and its SQL side by side."""

from pathlib import Path


def rows_of(frame):
    cols = sorted(frame.columns)
    plain = lambda x: repr(float(x)) if isinstance(x, float) else str(x)
    return cols, sorted(tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False))


def check(spark, sf, query, sql):
    got = query(spark, sf).toPandas()
    if sql is None:
        return got
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = con.execute(sql).df()
    assert rows_of(got) == rows_of(want)
    return got

"""Comparison of both engines' results."""


def plain(value):
    """A value as both engines' results are compared."""
    import datetime

    if value is None or value != value:
        return None
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value if isinstance(value, (bool, int, str, datetime.datetime)) else str(value)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)


def oracle_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    rows = [dict(zip(columns, r, strict=True)) for r in got.fetchall()]
    names = sorted(columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)

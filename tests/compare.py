"""Rows of two engines in one form: columns by name, rows sorted, numbers as floats."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType"):
        return "~"
    if isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return repr(float(x))
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return repr([value(v) for v in x])
    if hasattr(x, "isoformat"):
        return x.isoformat()
    try:
        return repr(round(float(x), 6))
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(value(x) for x in r) for r in df[cols].itertuples(index=False))


def duckdb_on(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c

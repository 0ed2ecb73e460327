"""Runs a query and its SQL twin over the same tables and says how the results differ."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 9) + 0.0
    return x if x is None or isinstance(x, bool | int) else str(x)


def rows(names: list, values: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(spark, con, f, sql: str, sf_dir: str) -> str:
    """Empty where both agree in names, rows and kinds of values."""
    df = f(spark, sf_dir)
    con.execute(sql)
    theirs_names = [c[0] for c in con.description]
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(theirs_names, con.fetchall())
    if sorted(df.columns) != sorted(theirs_names):
        return f"columns {sorted(df.columns)} and {sorted(theirs_names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} and {b}"
    return "" if mine else "no rows"

"""DuckDB over the driver's tables, and a comparison of rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET threads = 4; SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        if x is None or x is pd.NaT:
            return None
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return x.item() if hasattr(x, "item") else x

    rows = [tuple(value(x) for x in row) for row in df.itertuples(index=False)]
    return sorted(rows, key=repr)


def same_rows(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    a, b = _plain(found), _plain(expected)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]

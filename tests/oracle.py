"""A query's rows beside those of its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or (not isinstance(x, (list, tuple, dict)) and pd.isna(x)):
            return "null"
        if isinstance(x, float):
            return f"{x:.6f}"
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return str(x.item() if hasattr(x, "item") else x)

    return sorted(tuple(cell(x) if not (hasattr(x, "dtype") and x.dtype.kind == "f") else f"{float(x):.6f}" for x in row) for row in frame.itertuples(index=False))


def same(spark_frame, duck_frame) -> str:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(duck_frame.columns)}"
    a, b = normal(spark_frame), normal(duck_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x} and {y}"
    kinds = {c: (spark_frame[c].dtype.kind, duck_frame[c].dtype.kind) for c in spark_frame.columns if len(a)}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    return f"kinds {odd}" if odd else ""

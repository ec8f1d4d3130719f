"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query under its function's name, with the SQL that gives the same rows.

    Columns in dates leave as text, the same in any engine.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(f)
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = f(spark, sf_dir)
            return rows.withColumns({d: rows[d].cast("string") for d in dates}) if dates else rows

        QUERIES[f.__name__] = shown
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({sql})" if dates else sql
        return f

    return add


from . import feeds, history, links, ratings, scalars, sequences, streams, texts, matches, corrections, views, pages, posts, gates, snapshots, cards, identities, attributions, mentions, grammars, wikis  # noqa: E402, F401

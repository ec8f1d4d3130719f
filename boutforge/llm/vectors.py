"""Vectors for the searches: checked, packed, and equal ones brought together.

Rows with equal vectors form a class. For the best k of any query no more than the k + 1 smallest ids of
a class matter, so a vector that a third of all rows share counts as one row with a short list of ids,
and this loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDS = "packed binary, ids array<long>"


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the usable vectors of a list column: not null, no null or non-finite component."""
    lists = batch.column(column)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(n) - n
    for size in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == size)
        matrix = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(axis=1)
        yield rows[good], matrix[good]


def classes(table: DataFrame, k: int, convert: Callable[[np.ndarray], np.ndarray], *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """class_id (the smallest id), packed (the converted vector as doubles), ids (its k + 1 smallest ids).

    ``convert`` maps a matrix to the one to search; rows it makes all-NaN take no part.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["packed", "ids"])
            held.clear()
            return made

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, matrix in matrices(batch, 1):
                made = convert(matrix) + 0.0  # no negative zero
                good = ~np.isnan(made).any(axis=1)
                for i, row in zip(ids[rows[good]].tolist(), made[good], strict=True):
                    own = held.setdefault(row.tobytes(), [])
                    own.append(i)
                    if len(own) > 8 * (k + 1):
                        own.sort()
                        del own[k + 1 :]
            for own in held.values():
                own.sort()
                del own[k + 1 :]
            if len(held) > 20_000:
                yield out()
        yield out()

    def shortest(column: str):
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))), 1, k + 1).alias("ids")

    rows = table.where(f"`{key}` is not null").select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(pack, IDS)
    # in two steps, so that no task gathers a list from every other one
    some = rows.groupBy("packed", F.pmod(F.spark_partition_id(), F.lit(32)).alias("part")).agg(shortest("ids")).groupBy("packed").agg(shortest("ids"))
    return some.select(F.col("ids")[0].alias("class_id"), "packed", "ids", (F.octet_length("packed") / 8).cast("int").alias("dim"))


def query_map(table: DataFrame, every: int, k: int, convert, kept: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, class_id: the rows whose id is divisible by every, with the class of their vector."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, matrix in matrices(batch, 1):
                made = convert(matrix) + 0.0
                good = ~np.isnan(made).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[good]]), pa.array([r.tobytes() for r in made[good]], pa.binary())], names=["query_id", "packed"])

    queries = table.where(F.pmod(F.col(f"`{key}`"), F.lit(every)) == 0).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(pack, "query_id long, packed binary").distinct()
    return queries.join(kept.select("class_id", "packed"), "packed").select("query_id", "class_id")


def ranked(best: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from each class's sorted list of (score, vec_id) and the query rows."""
    own = queries.join(best, "class_id")
    rest = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(rest).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def sorted_best(column: Column, k: int) -> Column:
    """An array of (score, vec_id) structs, best first, ties to the smaller id, k + 1 of them."""
    falling = F.array_sort(F.transform(column, lambda x: F.struct((-x["score"]).alias("below"), x["vec_id"].alias("vec_id"))))
    return F.transform(F.slice(falling, 1, k + 1), lambda x: F.struct((-x["below"]).alias("score"), x["vec_id"].alias("vec_id")))


def merged(hits: DataFrame, k: int) -> DataFrame:
    """class_id, best: the k + 1 best of its rows' lists, in two steps so that no task gathers a list from every cell."""
    best = sorted_best(F.array_distinct(F.flatten(F.collect_list("best"))), k).alias("best")
    return hits.groupBy("class_id", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(best).groupBy("class_id").agg(best)


def stack(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)

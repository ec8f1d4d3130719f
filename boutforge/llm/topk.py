"""Operator 6: exact top-k search by distributed histogram selection.

Queries and candidates meet in cells, blocks of each against blocks of the other. A pass scores every
cell and counts scores in bins between bounds that each query has; the counts of all cells, summed by
query, show the bin that holds the k-th value, and the next pass counts within that bin, until a bin is
one value wide. A last pass keeps what lies above the k-th value and, of what equals it, the smallest
ids. A cell need not send bins below its own k-th value, since the k-th value of all is not less.

Scores are integer inner products: exact in doubles while dim * max**2 < 2**53, else in 64-bit
integers. Vectors of different length have no score together.

Defined cases: a vector that is null or empty or has a null or non-finite component takes no part; a
null id takes no part; rows repeated with one id and vector count once; fewer candidates than k are all
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, vectors

BINS = 1024
QUERY_BLOCK, ROW_BLOCK, CHUNK = 2048, 4096, 1024


def scaled(matrix: np.ndarray) -> np.ndarray:
    return np.floor(64 * matrix)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bound = queries.shape[1] * (np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0))
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def cells(queries: DataFrame, rows: DataFrame, query_blocks: int, row_blocks: int) -> DataFrame:
    """Each row of either side in every cell of its block, ordered so that a cell's queries come first."""
    q = queries.select("dim", F.pmod(F.xxhash64("class_id"), F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"), F.lit(0).alias("side"), "class_id", "packed", F.array().cast("array<long>").alias("ids"), "low", "width")
    r = rows.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("class_id"), F.lit(row_blocks)).alias("rb"), F.lit(1).alias("side"), "class_id", "packed", "ids", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("width"))
    both = q.unionByName(r)
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(query_blocks * row_blocks, 4096))
    return both.repartition(parts, "dim", "qb", "rb").sortWithinPartitions("dim", "qb", "rb", "side")


def scored_cells(batches: Iterable[pa.RecordBatch], start: Callable, each: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Run over cells: start(block, query ids, low, width), then each(scores, ids of the rows) by chunk, then end()."""
    key = None
    q: list[tuple] = []
    r: list[tuple] = []
    matrix = None

    def flush() -> None:
        nonlocal matrix, r
        if q and r:
            if matrix is None:
                start(key[1], *(np.array([x[k] for x in q], np.int64) for k in (0, 2, 3)))
                matrix = vectors.stack([x[1] for x in q])
            each(products(matrix, vectors.stack([x[1] for x in r])), [x[2] for x in r])
        r = []

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(9)]
        for dim, qb, rb, side, class_id, packed, ids, low, width in zip(*columns, strict=True):
            if (dim, qb, rb) != key:
                flush()
                if matrix is not None:
                    yield from end()
                key, q, matrix = (dim, qb, rb), [], None
            if side == 0:
                q.append((class_id, packed, low, width))
            elif q:
                r.append((class_id, packed, ids))
                if len(r) == CHUNK:
                    flush()
    flush()
    if matrix is not None:
        yield from end()


def _count(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def start(block, ids, low, width):
            state.update(block=block, ids=ids, low=low, width=width, n=np.zeros(len(ids) * (BINS + 1), np.int64))

        def each(scores, ids):
            weight = np.array([len(x) for x in ids], float)
            offset = (scores - state["low"][:, None]) // state["width"][:, None]
            code = np.where(offset >= BINS, BINS, offset) + np.arange(len(scores))[:, None] * (BINS + 1)
            inside = offset >= 0
            state["n"] += np.bincount(code[inside], np.broadcast_to(weight, scores.shape)[inside], len(state["n"])).astype(np.int64)

        def end():
            n = state["n"].reshape(-1, BINS + 1)[:, ::-1]
            before = np.cumsum(n, axis=1) - n
            query, bin_ = np.nonzero((n > 0) & (before < k))
            cuts = np.searchsorted(query, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (BINS - bin_, n[query, bin_])]
            yield pa.RecordBatch.from_arrays([pa.array(state["ids"]), pa.array(state["low"]), pa.array(state["width"]), *lists], names=["class_id", "low", "width", "bins", "counts"])

        yield from scored_cells(batches, start, each, end)

    return run


def _narrow(k: int):
    """Sum the cells' counts by query and step into the bin of the k-th value; rows come sorted by class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low, width, total = None, 0, 0, None

        def done():
            before = np.cumsum(total[::-1])
            at = int(np.searchsorted(before, k))
            if at > BINS:
                return last, low, 0  # fewer than k candidates: all that lie above the lowest bound
            # a bin of one value is the k-th value itself, which a width of 0 says
            return last, low + (BINS - at) * width, -(-width // BINS) if width > 1 else 0

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in range(3)]
            for row, (class_id, lo, wide) in enumerate(zip(*columns, strict=True)):
                if class_id != last:
                    if last is not None:
                        out.append(done())
                    last, low, width, total = class_id, lo, wide, np.zeros(BINS + 1, np.int64)
                total[batch.column(3)[row].values.to_numpy()] += batch.column(4)[row].values.to_numpy()
            yield _bounds(out)
        if last is not None:
            yield _bounds([done()])

    return run


def _bounds(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["class_id", "low", "width"])


def _keep(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def start(block, ids, low, width):
            state.update(ids=ids, low=low, above=[[] for _ in ids], equal=[[] for _ in ids])

        def each(scores, ids):
            query, row = np.nonzero(scores >= state["low"][:, None])
            for q, r, s in zip(query.tolist(), row.tolist(), scores[query, row].tolist(), strict=True):
                if s > state["low"][q]:
                    state["above"][q] += [(s, i) for i in ids[r]]
                else:
                    state["equal"][q] += [(s, i) for i in ids[r]]
                    if len(state["equal"][q]) > 8 * k:
                        state["equal"][q] = sorted(state["equal"][q])[:k]

        def end():
            best = [sorted(a + e, key=lambda x: (-x[0], x[1]))[:k] for a, e in zip(state["above"], state["equal"], strict=True)]
            rows = [{"class_id": c, "best": [{"score": s, "vec_id": i} for s, i in b]} for c, b in zip(state["ids"].tolist(), best, strict=True) if b]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("class_id", pa.int64()), ("best", pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))]))

        yield from scored_cells(batches, start, each, end)

    return run


def search(table: DataFrame, *, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by every, against all others."""
    wanted = k + 1  # a query's own row is among its best and is left out last
    rows = tables.stored(vectors.classes(table, k, scaled, key=key, vector=vector))
    map_ = tables.stored(vectors.query_map(table, every, k, scaled, rows, key=key, vector=vector))
    queries = rows.join(map_.select("class_id").distinct(), "class_id", "left_semi")
    sizes = rows.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    row_blocks, query_blocks = (max(1, -(-n // b)) for n, b in zip(sizes, (ROW_BLOCK, QUERY_BLOCK), strict=True))
    spark = table.sparkSession
    norm = rows.mapInArrow(_norms, "norm double").agg(F.max("norm")).first()[0] or 0.0
    # no score exceeds the product of norms; one more for rounding
    own = queries.mapInArrow(_with_norms, "class_id long, own double")
    bound = F.ceil(F.col("own") * F.lit(norm)).cast("long") + 1
    state = tables.stored(own.select("class_id", (-bound).alias("low"), F.ceil((2 * bound + 1) / F.lit(BINS)).cast("long").alias("width")))
    schema = "class_id long, low long, width long, bins array<long>, counts array<long>"
    while True:
        width = state.agg(F.max("width")).first()[0]
        if not width:
            break
        open_ = queries.join(state.where("width > 0"), "class_id")
        counted = cells(open_, rows, query_blocks, row_blocks).mapInArrow(_count(wanted), schema)
        narrowed = counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "class_id").sortWithinPartitions("class_id").mapInArrow(_narrow(wanted), "class_id long, low long, width long")
        state = tables.stored(narrowed.unionByName(state.where("width = 0")))
    final = cells(queries.join(state, "class_id"), rows, query_blocks, row_blocks).mapInArrow(_keep(wanted), "class_id long, best array<struct<score:long,vec_id:long>>")
    return vectors.ranked(vectors.merged(final, k), map_, k)


def _norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = batch.column(batch.schema.get_field_index("packed")).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(np.frombuffer(p))) for p in packed], pa.float64())], names=["norm"])


def _with_norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = batch.column(batch.schema.get_field_index("packed")).to_pylist()
        ids = batch.column(batch.schema.get_field_index("class_id"))
        yield pa.RecordBatch.from_arrays([ids, pa.array([float(np.linalg.norm(np.frombuffer(p))) for p in packed], pa.float64())], names=["class_id", "own"])

"""Operator 7: approximate nearest neighbours by inner product over shifted Hilbert curves.

Each curve has its own rotation and shift: a vector is projected to DIMENSIONS numbers, put on a grid
and given its place along the Hilbert curve through the grid. Spark ranges each curve's places into
blocks of about equal numbers of rows. A query looks through its own block and REACH blocks on either
side on every curve; what the curves find is merged and ranked by exact inner products.

All rows are indexed; moments of all rows set the grid. A window holds a share of the rows,
(2 * REACH + 1) / BLOCKS, not a fixed number, as recall on vectors without structure depends on
the share that is looked at. Blocks of many rows split into cells, so work spreads at any size.

Defined cases: a vector that is null, empty, zero or has a null or non-finite component takes no part;
a null id takes no part; rows repeated with one id and vector count once; vectors of different length
have no score together; fewer candidates than k are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, vectors

CURVES, DIMENSIONS, BITS = 18, 8, 4
BLOCKS, REACH = 50, 2
CELL_ROWS, CELL_QUERIES = 8192, 4096
ROWS_AT_ONCE = 4096


def usable(matrix: np.ndarray) -> np.ndarray:
    return np.where((matrix != 0).any(axis=1)[:, None], matrix, np.nan)


def frame(dim: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """A curve's projection (orthonormal columns) and shift, fixed by its number."""
    random = np.random.default_rng([dim, curve])
    d = min(DIMENSIONS, dim)
    q, r = np.linalg.qr(random.normal(size=(dim, d)))
    return q * np.sign(np.diag(r)), random.random(d)


def curve_place(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid, whose entries lie in [0, 2**bits).

    From the top bit down, a set bit in an axis inverts the first axis's lower bits and a clear one
    exchanges them with that axis's; the axes' bits then make a Gray code, which is read off as a number.
    """
    x = [c.astype(np.int64) for c in grid.T]
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for k in range(len(x)):
            up = (x[k] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[k]) & below)
            x[0] = np.where(up, x[0] ^ below, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    place = np.zeros(len(grid), np.int64)
    parity = np.zeros(len(grid), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            parity ^= axis >> b & 1
            place = place << 1 | parity
    return place


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        packed = batch.column(0).to_pylist()
        for size in {len(p) for p in packed}:
            m = vectors.stack([p for p in packed if len(p) == size])
            have = total.setdefault(size // 8, [0, 0.0, 0.0])
            have[0] += len(m)
            have[1] = have[1] + m.sum(0)
            have[2] = have[2] + m.T @ m
    rows = list(total.items())
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int32()), pa.array([x[0] for _, x in rows], pa.int64()), pa.array([x[1].tobytes() for _, x in rows], pa.binary()), pa.array([x[2].tobytes() for _, x in rows], pa.binary())], names=["dim", "n", "first", "second"])


def _add_moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for dim, n, first, second in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            have = total.setdefault(dim, [0, 0.0, 0.0])
            have[0] += n
            have[1] = have[1] + np.frombuffer(first)
            have[2] = have[2] + np.frombuffer(second)
    rows = list(total.items())
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int32()), pa.array([x[0] for _, x in rows], pa.int64()), pa.array([x[1].tobytes() for _, x in rows], pa.binary()), pa.array([x[2].tobytes() for _, x in rows], pa.binary())], names=["dim", "n", "first", "second"])


def placed(rows: DataFrame) -> DataFrame:
    """rows once for each curve, with place; needs dim and packed."""
    schema = "dim int, n long, first binary, second binary"
    parts = rows.select("packed").mapInArrow(_moments, schema)
    moments = {}
    for dim, n, first, second in parts.repartition(8, "dim").mapInArrow(_add_moments, schema).collect():  # one row for each vector length
        mean = np.frombuffer(first) / n
        moments[dim] = mean, np.frombuffer(second).reshape(dim, dim) / n - np.outer(mean, mean)
    shared = rows.sparkSession.sparkContext.broadcast(moments)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames: dict = {}
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index("packed")).to_pylist()
            sizes = np.array([len(p) // 8 for p in packed])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                m = vectors.stack([packed[k] for k in at.tolist()])
                part = batch.take(pa.array(at))
                for curve in range(CURVES):
                    if (dim, curve) not in frames:
                        basis, shift = frame(dim, curve)
                        mean, covariance = shared.value[dim]
                        spread = np.sqrt(np.maximum(np.diag(basis.T @ covariance @ basis), 1e-300))
                        frames[dim, curve] = basis, mean @ basis, 5 * spread, shift
                    basis, middle, span, shift = frames[dim, curve]
                    unit = np.clip((m @ basis - middle) / span + 0.5, 0, 1)
                    grid = np.minimum(((unit + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                    place = curve_place(grid, BITS)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), curve, np.int32)), pa.array(place)], names=[*part.schema.names, "curve", "place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, curve int, place long")


def search(table: DataFrame, *, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by every, against all others."""
    spark = table.sparkSession
    rows = tables.stored(vectors.classes(table, k, usable, key=key, vector=vector))
    map_ = tables.stored(vectors.query_map(table, every, k, usable, rows, key=key, vector=vector))
    n = rows.agg(F.count("*")).first()[0]
    n_queries = map_.select("class_id").distinct().count()
    queried = map_.select("class_id").distinct().withColumn("query", F.lit(True))
    flagged = rows.join(queried, "class_id", "left").withColumn("query", F.coalesce("query", F.lit(False)))
    along = tables.stored(placed(flagged))
    # rows at one place count as they come: the blocks' bounds are quantiles of the places
    steps = [i / BLOCKS for i in range(1, BLOCKS)]
    bounds = along.groupBy("dim", "curve").agg(F.percentile_approx("place", F.array(*map(F.lit, steps)), F.lit(20 * BLOCKS)).alias("bounds"))
    block = F.size(F.filter("bounds", lambda x: x < F.col("place")))
    blocks = along.join(F.broadcast(bounds), ["dim", "curve"]).withColumn("block", block)  # CURVES rows for each vector length
    row_cells = max(1, -(-n // (BLOCKS * CELL_ROWS)))
    query_cells = max(1, -(-n_queries * (2 * REACH + 1) // (BLOCKS * CELL_QUERIES)))
    own = F.pmod(F.xxhash64("class_id"), F.lit(row_cells)).cast("int")
    kind = F.pmod(F.xxhash64("class_id", F.lit(7)), F.lit(query_cells)).cast("int")
    sides = ["dim", "curve", "block", "rs", "qs", "side", "class_id", "packed", "ids"]
    corpus = blocks.withColumn("rs", own).withColumn("qs", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1)))).withColumn("side", F.lit(1)).select(*sides)
    near = F.sequence(F.greatest(F.col("block") - REACH, F.lit(0)), F.least(F.col("block") + REACH, F.lit(BLOCKS - 1)))
    asked = blocks.where("query").withColumn("block", F.explode(near)).withColumn("qs", kind).withColumn("rs", F.explode(F.sequence(F.lit(0), F.lit(row_cells - 1)))).withColumn("side", F.lit(0)).withColumn("ids", F.array().cast("array<long>")).select(*sides)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(CURVES * BLOCKS * row_cells * query_cells // 4, 4096) if n > 10 * CELL_ROWS else 1)
    cell = ["dim", "curve", "block", "rs", "qs"]
    met = corpus.unionByName(asked).withColumn("cell", F.xxhash64(*cell)).repartition(parts, "cell").sortWithinPartitions("cell", "dim", "side")
    found = met.select("cell", "dim", "side", "class_id", "packed", "ids")
    hits = found.mapInArrow(_nearest(k + 1), "class_id long, best array<struct<score:double,vec_id:long>>")
    return vectors.ranked(vectors.merged(hits, k), map_, k)


def _nearest(k: int):
    """The best k rows of each cell for each of its queries; each (query, row) is scored alike in every cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        q: list[tuple] = []
        r: list[tuple] = []
        best: list[list[tuple]] = []
        matrix = None

        def flush() -> None:
            nonlocal matrix, best, r
            if q and r:
                if matrix is None:
                    matrix, best = vectors.stack([x[1] for x in q]), [[] for _ in q]
                m = vectors.stack([x[1] for x in r])
                scores = matrix @ m.T
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if len(r) > k else np.tile(np.arange(len(r)), (len(q), 1))
                least = np.take_along_axis(scores, top, axis=1).min(axis=1)
                near = least - 1e-9 * (1 + np.abs(least))  # ties, and what rounding might set apart
                at, row = np.nonzero(scores >= near[:, None])
                exact = np.einsum("ij,ij->i", matrix[at], m[row])
                for a, b, s in zip(at.tolist(), row.tolist(), exact.tolist(), strict=True):
                    best[a] += [(-s, i) for i in r[b][2]]
                for a in range(len(q)):
                    best[a] = sorted(best[a])[:k]
            r = []

        def done() -> Iterator[pa.RecordBatch]:
            if matrix is not None:
                rows = [{"class_id": x[0], "best": [{"score": -s, "vec_id": i} for s, i in b]} for x, b in zip(q, best, strict=True) if b]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("class_id", pa.int64()), ("best", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))]))

        for batch in batches:
            for cell, dim, side, class_id, packed, ids in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (cell, dim) != key:
                    flush()
                    yield from done()
                    key, q, r, matrix = (cell, dim), [], [], None
                if side == 0:
                    q.append((class_id, packed))
                elif q:
                    r.append((class_id, packed, ids))
                    if len(r) == ROWS_AT_ONCE:
                        flush()
        flush()
        yield from done()

    return run

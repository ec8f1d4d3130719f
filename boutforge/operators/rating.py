"""Sequential ratings, eligibility and ranking.

The rating of a bout depends on all earlier bouts of both sides. Bouts are sorted by date in many tasks and cut into
pieces, which number their fighters and know which of their bouts can be played at once: those whose sides have no
earlier bout of the piece left. One task then carries the ratings from piece to piece, and all pieces are played
again, in many tasks, from the ratings that they began with. The one task gets numbers and names only, holds a piece
and a rating for each fighter, and the ratings are those of one replay in order.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .lineage import checkpointed
from .windows import pulled_up


@dataclass(frozen=True)
class Tilt:
    """How much more or less a result moves a rating by the opponent's standing."""

    strong_win: float = 1.0
    weak_win: float = 1.0
    strong_loss: float = 1.0
    weak_loss: float = 1.0
    thin_fights: int = 0
    thin_win: float = 1.0


LIVE = Tilt(1.8, 0.7, 0.9, 1.1, 3, 0.5)


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a task's edges: each node with the smallest one it is joined to."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for a, b in zip(frame["x"], frame["y"], strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, root(x)) for x in parent], columns=["x", "y"])


def components(bouts: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable. Tasks unite what they have, then minima spread until nothing changes."""
    stars = bouts.select(F.col("a").cast("string").alias("x"), F.col("b").cast("string").alias("y")).mapInPandas(_united, "x string, y string").distinct()
    edges = checkpointed(stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component"))
    while True:
        spread = edges.join(label, edges["y"] == label["node"]).groupBy("x").agg(F.min("component").alias("near"))
        jumped = label.join(spread, label["node"] == spread["x"]).select("node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        # a label is itself a node: its own label is a shorter way
        short = jumped.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = checkpointed(jumped.join(short, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "moved"))
        label = new.select("node", "component")
        if not new.where("moved").take(1):
            return label


def _packed(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.BinaryScalar) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(data.as_buffer()) as found:
        batch = found.read_next_batch()
    return dict(zip(batch.schema.names, batch.columns, strict=True))


def _levels(a: np.ndarray, b: np.ndarray, fighters: int) -> np.ndarray:
    """For each bout how many must be played before it, one after another, by either side."""
    done, found = [0] * fighters, array("i")
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = done[i], done[j]
        if x < y:
            x = y
        found.append(x)
        done[i] = done[j] = x + 1
    return np.frombuffer(found, "i")


PIECES = "piece long, day int, first string, n int, bouts binary, names binary, told binary"
WIDE = 24  # bouts of a level, from which arrays take less time than a loop


def _pieces(size: int):
    """Bouts in order, cut into pieces: of each its numbers in the order of levels, its fighters' names, and the rest."""

    def piece(rows: pa.Table, n: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        of = lambda c: rows[c].combine_chunks() if rows.num_rows else rows[c]
        sides = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks]).combine_chunks().dictionary_encode()
        codes = sides.indices.to_numpy()
        a, b = codes[: rows.num_rows], codes[rows.num_rows :]
        level = _levels(a, b, len(sides.dictionary))
        order = np.argsort(level, kind="stable")
        starts = np.zeros(rows.num_rows, "?")
        starts[np.searchsorted(level[order], np.arange(level.max() + 1))] = True
        names = {"name": sides.dictionary}
        if "seed_a" in rows.column_names:
            seeds = np.full(len(sides.dictionary), np.nan)
            for code, side in ((a, "seed_a"), (b, "seed_b")):
                seeds[code] = of(side).to_numpy(zero_copy_only=False)
            names["seed"] = pa.array(seeds)
        put = lambda c: of(c).take(pa.array(order))
        data = {
            "piece": (TaskContext.get().partitionId() << 32) + n,
            "day": rows["date"][0].cast(pa.int32()).as_py(),
            "first": rows["key"][0].as_py(),
            "n": n,
            "bouts": _packed(a=pa.array(a[order]), b=pa.array(b[order]), score=put("score_a"), finish=put("finish"), starts=pa.array(starts)),
            "names": _packed(**names),
            "told": _packed(key=put("key"), date=put("date")),
        }
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(data.values(), kinds, strict=True)], names=list(data))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = rows = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == size:
                    yield piece(pa.Table.from_batches(held), n)
                    held, rows, n = [], 0, n + 1
        if held:
            yield piece(pa.Table.from_batches(held), n)

    return cut


def replay(bouts: dict[str, pa.Array], tilt: Tilt, rating: np.ndarray, fights: np.ndarray, told: list[np.ndarray] | None = None) -> None:
    """Play a piece's bouts from its fighters' ratings and numbers of bouts, which change in place.

    told takes what stood before and after each bout: before, before, after, after, fights, fights of both sides.
    """
    a, b, s = (bouts[c].to_numpy() for c in ("a", "b", "score"))
    won, lost, n = s == 1, s == 0, len(s)
    k = np.where(bouts["finish"].to_numpy(zero_copy_only=False).astype("?"), scores.K_FINISH, scores.K_BASE)
    starts = np.flatnonzero(bouts["starts"].to_numpy(zero_copy_only=False))
    if n < WIDE * len(starts):
        return _replay_singly(a, b, s, k, tilt, rating, fights, told)
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
        now = slice(low, high)
        i, j, w, d, kk = a[now], b[now], won[now], lost[now], k[now]
        x, y, m, o = rating[i], rating[j], fights[i], fights[j]
        # powers by Python's own, so that ratings are the same however bouts are dealt
        expected = 1 / (1 + np.array([10.0**t for t in ((y - x) / 400).tolist()]))
        above, below, gain = y > x, x > y, s[now] - expected
        of_a = np.where(w, np.where(above, tilt.strong_win, tilt.weak_win), np.where(d, np.where(above, tilt.strong_loss, tilt.weak_loss), 1.0))
        of_b = np.where(d, np.where(below, tilt.strong_win, tilt.weak_win), np.where(w, np.where(below, tilt.strong_loss, tilt.weak_loss), 1.0))
        thin_a, thin_b = np.where(w & (o < tilt.thin_fights), tilt.thin_win, 1.0), np.where(d & (m < tilt.thin_fights), tilt.thin_win, 1.0)
        up, down = x + kk * of_a * thin_a * gain, y + kk * of_b * thin_b * -gain
        rating[i], rating[j], fights[i], fights[j] = up, down, m + 1, o + 1
        if told is not None:
            for array_, values in zip(told, (x, y, up, down, m + 1, o + 1), strict=True):
                array_[now] = values


def _replay_singly(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: np.ndarray, tilt: Tilt, rating: np.ndarray, fights: np.ndarray, told: list[np.ndarray] | None) -> None:
    """The same one by one, where hardly any bouts can be played at once."""
    ratings, counts = rating.tolist(), fights.tolist()
    rows: list[tuple] = []
    for i, j, s_, k_ in zip(a.tolist(), b.tolist(), s.tolist(), k.tolist(), strict=True):
        x, y, m, o = ratings[i], ratings[j], counts[i], counts[j]
        expected = 1 / (1 + 10.0 ** ((y - x) / 400))
        up, down = x, y
        if s_ == 1:
            up += k_ * (tilt.strong_win if y > x else tilt.weak_win) * (tilt.thin_win if o < tilt.thin_fights else 1.0) * (1 - expected)
            down += k_ * (tilt.strong_loss if x > y else tilt.weak_loss) * (expected - 1)
        elif s_ == 0:
            up += k_ * (tilt.strong_loss if y > x else tilt.weak_loss) * -expected
            down += k_ * (tilt.strong_win if x > y else tilt.weak_win) * (tilt.thin_win if m < tilt.thin_fights else 1.0) * expected
        else:
            up += k_ * (s_ - expected)
            down += k_ * (expected - s_)
        ratings[i], ratings[j], counts[i], counts[j] = up, down, m + 1, o + 1
        if told is not None:
            rows.append((x, y, up, down, m + 1, o + 1))
    rating[:], fights[:] = ratings, counts
    for array_, values in zip(told or [], zip(*rows, strict=True), strict=True):
        array_[:] = values


def _carried(tilt: Tilt):
    """Pieces in order: the ratings and numbers of bouts that each one's fighters begin with."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = defaultdict(itertools.count().__next__)  # a new name takes the next
        rating, fights = np.empty(0), np.empty(0, "i")
        for batch in batches:
            for piece, bouts, names in zip(batch["piece"], batch["bouts"], batch["names"], strict=True):
                known, named = len(place), _unpacked(names)
                at = np.fromiter(map(place.__getitem__, named["name"].to_numpy(zero_copy_only=False)), "i", len(named["name"]))
                rating, fights = np.concatenate([rating, np.full(len(place) - known, scores.INITIAL_RATING)]), np.concatenate([fights, np.zeros(len(place) - known, "i")])
                if "seed" in named:
                    seeds = named["seed"].to_numpy()
                    first = (at >= known) & ~np.isnan(seeds)
                    rating[at[first]] = seeds[first]
                own, count = rating[at], fights[at]
                yield pa.RecordBatch.from_arrays([pa.array([piece.as_py()]), pa.array([_packed(rating=pa.array(own), fights=pa.array(count))])], names=["piece", "state"])
                own, count = own.copy(), count.copy()
                replay(_unpacked(bouts), tilt, own, count)
                rating[at], fights[at] = own, count

    return carry


TRACE = "key string, date date, fighter string, opponent string, score double, before double, after double, fights int"
ROWS = 65_536  # of an Arrow batch


def _told(tilt: Tilt):
    """The trace of pieces, each from the state it begins with."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bouts, names, told, state in zip(*(batch[c] for c in ("bouts", "names", "told", "state")), strict=True):
                bouts, names, told, state = _unpacked(bouts), _unpacked(names)["name"], _unpacked(told), _unpacked(state)
                n = len(bouts["a"])
                found = [np.empty(n, "i" if k > 3 else "d") for k in range(6)]
                replay(bouts, tilt, state["rating"].to_numpy().copy(), state["fights"].to_numpy().copy(), found)
                score = bouts["score"].to_numpy()
                for own, other, k in (("a", "b", 0), ("b", "a", 1)):
                    values = [names.take(bouts[own]), names.take(bouts[other]), *map(pa.array, (1 - score if k else score, found[k], found[k + 2], found[k + 4]))]
                    side = pa.RecordBatch.from_arrays([told["key"], told["date"], *values], names=["key", "date", "fighter", "opponent", "score", "before", "after", "fights"])
                    for low in range(0, n, ROWS):
                        yield side.slice(low, ROWS)

    return tell


def trace(bouts: DataFrame, tilt: Tilt = LIVE, seeds: DataFrame | None = None, *, slice_bouts: int = 500_000, tasks: int | None = None) -> DataFrame:
    """The rating of both sides before and after every bout (key, date, a, b, score_a, finish).

    Bouts without a score don't count, nor do those without a side. seeds (fighter, seed) gives first ratings other than
    the usual. Bouts are played in order of date and key, in pieces of at most slice_bouts; tasks is the number of those
    that sort them, cut them into pieces and tell the trace.
    """
    tasks = tasks or bouts.sparkSession.sparkContext.defaultParallelism
    played = bouts.select(F.col("key").cast("string").alias("key"), F.col("date").cast("date").alias("date"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("score_a").cast("double").alias("score_a"), F.coalesce(F.col("finish").cast("boolean"), F.lit(False)).alias("finish"))
    played = played.where("score_a is not null and date is not null and a is not null and b is not null")
    if seeds is not None:
        for side in ("a", "b"):
            played = played.join(seeds.select(F.col("fighter").cast("string").alias(side), F.col("seed").cast("double").alias(f"seed_{side}")), side, "left")
    ordered = played.repartitionByRange(tasks, "date", "key").sortWithinPartitions("date", "key", "a", "b", "score_a", "finish")
    pieces = checkpointed(ordered.mapInArrow(_pieces(slice_bouts), PIECES))
    in_order = pieces.select("piece", "day", "first", "n", "bouts", "names").repartition(1).sortWithinPartitions("day", "first", "n")
    states = in_order.select("piece", "bouts", "names").mapInArrow(_carried(tilt), "piece long, state binary")
    dealt = pieces.select("piece", "bouts", "names", "told").repartition(tasks, "piece").join(states.repartition(tasks, "piece"), "piece")
    return dealt.select("bouts", "names", "told", "state").mapInArrow(_told(tilt), TRACE)


def states(traced: DataFrame) -> DataFrame:
    """The last rating of each fighter and what it was made from."""
    last = F.max_by("after", "fights")
    return traced.groupBy("fighter").agg(
        last.alias("rating"),
        F.max("fights").alias("fights"),
        F.count(F.when(F.col("score") == 1, 1)).alias("wins"),
        F.count(F.when(F.col("score") == 0, 1)).alias("losses"),
        F.count(F.when(F.col("score") == 0.5, 1)).alias("draws"),
        F.max("date").alias("last_date"),
    )


def eligibility(sides: DataFrame, as_of: Column, *, tie: str = "bout_id", recent_from: str = "2025-01-01") -> DataFrame:
    """Bouts and wins that count for each (fighter, current division), and whether they suffice.

    Openers don't count; nor what lies before a change of division, or before an absence of over 18
    months unless the fighter had four bouts by then. Three bouts, or two since recent_from, one win
    and a bout within 18 months are needed.
    """
    # every window and the last sums have fighters together, so rows are dealt once
    mine = Window.partitionBy("fighter")
    order = mine.orderBy("date", tie)
    counted = sides.where("not opener").select("fighter", "date", tie, "division", "current", "result")
    before = F.lag("date").over(order)
    previous = F.last("division", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first("division", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = counted.withColumns({"before": before, "previous": previous, "following": following})
    away = F.datediff("date", "before") > 18 * scores.ELIGIBLE_MONTH_DAYS
    trip = F.coalesce((F.col("previous") == F.col("current")) & (F.col("following") == F.col("current")), F.lit(False))
    gaps = seen.withColumns({"gap": F.max(F.when(away, F.col("before"))).over(mine), "moved": F.max(F.when((F.col("division") != F.col("current")) & ~trip, F.col("date"))).over(mine)})
    veteran = F.sum(F.when(F.col("date") <= F.col("gap"), 1).otherwise(0)).over(mine) >= 4
    cutoff = F.greatest(F.when(~veteran, F.col("gap")), F.col("moved"))
    inside = gaps.withColumn("cutoff", cutoff).withColumn("inside", F.col("cutoff").isNull() | (F.col("date") > F.col("cutoff")))
    sums = inside.groupBy("fighter").agg(
        F.count(F.when(F.col("inside"), 1)).alias("fights"),
        F.count(F.when(F.col("inside") & (F.col("result") == "win"), 1)).alias("wins"),
        F.count(F.when(F.col("inside") & (F.col("date") >= F.lit(recent_from).cast("date")), 1)).alias("recent"),
        F.max("date").alias("last_date"),
    )
    bar = (F.col("fights") >= 3) | (F.col("recent") >= 2)
    fresh = F.datediff(as_of, F.col("last_date")) / scores.ELIGIBLE_MONTH_DAYS <= 18
    return sums.withColumn("eligible", bar & (F.col("wins") >= 1) & fresh)


def ranking(rated: DataFrame, order: list[Column], *by: str) -> DataFrame:
    """Positions by the discounted rating."""
    return rated.withColumn("rank_score", scores.sigma_discount(F.col("rating"), F.col("fights"))).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rank_score"), *order)))


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: list[str], shown: int) -> DataFrame:
    """What changed between two rankings (keys, rank): champion, vacated, new, dropped, up, down; equals are left out."""
    p = previous.select(*keys, F.col("rank").alias("before"))
    c = current.select(*keys, F.col("rank").alias("after"))
    b, a = F.col("before"), F.col("after")
    kind = (
        F.when((a == 1) & (b.isNull() | (b != 1)), "champion")
        .when((b == 1) & a.isNull(), "vacated")
        .when(b.isNull(), "new")
        .when(a.isNull(), "dropped")
        .when(a < b, "up")
        .when(a > b, "down")
    )
    return p.where(b <= shown).join(c.where(a <= shown), keys, "full").withColumn("change", kind).where("change is not null")


def ripples(previous: DataFrame, current: DataFrame, played: DataFrame, least: float = 0.001) -> DataFrame:
    """Fighters whose rating moved although they had no bout: changes that come from others'."""
    p, c = previous.select("fighter", F.col("rating").alias("before")), current.select("fighter", F.col("rating").alias("after"))
    return p.join(c, "fighter").where(F.abs(F.col("after") - F.col("before")) > least).join(played.select("fighter").distinct(), "fighter", "left_anti")


def pound_for_pound(rows: DataFrame, order: list[Column], *, top: int, per_title: float = 15.0) -> DataFrame:
    """rows (division, fighter, rating, title_value): the first of each division in that order, ranked over all divisions.

    No one scores less than anyone below in the division. Only the first of each division travel; of all
    others their highest score is enough.
    """
    scored = rows.withColumn("own_score", F.col("rating") + per_title * F.coalesce("title_value", F.lit(0.0)))
    first = scored.withColumn("position", F.row_number().over(Window.partitionBy("division").orderBy(*order))).where(F.col("position") <= top)
    others = scored.join(first.select("division", "fighter"), ["division", "fighter"], "left_anti").groupBy("division").agg(F.max("own_score").alias("__below"))
    up = pulled_up(first.join(others, "division", "left"), "division", "position", "own_score", "score").withColumn("score", F.greatest("score", "__below")).drop("__below")
    # a division's first few, so one window over all is small
    return up.withColumn("p4p_rank", F.row_number().over(Window.orderBy(F.desc("score"), "position", "fighter", "division")))

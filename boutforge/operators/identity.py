"""Entities of several rosters, and repeats of bouts, found in passes under constraints.

Both are greedy by a fixed order. Edges of different connected parts don't meet, so rosters are cut into parts, and
those of up to ``part_edges`` edges are gone through in tasks that hold some parts each. In larger ones an edge
between two clusters is decided when it is the first one left at both of them. Constraints only tighten as clusters
grow, so all such edges can be decided at once, and rounds of them, until parts are small, give what going through all
edges one by one would. A round is a handful of joins and aggregates; the number of rounds isn't that of a chain of
edges each of which waits for the one before, unless a part is large. Repeats of bouts concern one pair each: its
tellings come together and in order by one shuffle, and are gone through once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lineage import checkpointed
from .rating import components

ROWS = 4096  # of an Arrow batch


def _compatible(a: Column, b: Column) -> Column:
    """No gym of one set is other than each of the other set: equal names, or one within the other."""
    return F.forall(a, lambda x: F.forall(b, lambda y: (x == y) | x.contains(y) | y.contains(x)))


def _fits(a: set[str], b: set[str]) -> bool:
    return all(x == y or y in x or x in y for x in a for y in b)


def _gone_through(frame: pd.DataFrame, conflicts: bool) -> pd.DataFrame:
    """Clusters (root: as before, into, sources, gyms) that edges of whole parts, one after another, have changed."""
    into: dict[int, int] = {}
    sets: dict[int, tuple[set[str], set[str]]] = {}

    def now(x: int) -> int:
        while into.setdefault(x, x) != x:
            into[x] = into[into[x]]
            x = into[x]
        return x

    frame = frame.sort_values(["block", "i", "j"])
    for i, j, *known in zip(*(frame[c] for c in ("root_i", "root_j", "sources_i", "gyms_i", "sources_j", "gyms_j")), strict=True):
        for root, sources, gyms in ((i, *known[:2]), (j, *known[2:])):
            if root not in sets:
                sets[root] = (set(sources), set(gyms))
        low, high = sorted((now(i), now(j)))
        (s, g), (t, h) = sets[low], sets[high]
        if low != high and s.isdisjoint(t) and (conflicts or _fits(g, h)):
            into[high] = low
            sets[low] = (s | t, g | h)
    ends = {x: now(x) for x in list(into)}
    changed = {r for x, r in ends.items() if x != r}
    return pd.DataFrame([(x, r, sorted(sets[r][0]), sorted(sets[r][1])) for x, r in ends.items() if r in changed], columns=["root", "into", "s", "g"])


def _contracted(edges: DataFrame, nodes: DataFrame, *, conflicts: bool, part_edges: int) -> DataFrame:
    """nodes (ord, root, sources, gyms: those of its cluster) after all edges (i, j, at: order among edges)."""
    open_ = edges
    while True:
        side = lambda name: nodes.select(F.col("ord").alias(name), F.col("root").alias(f"root_{name}"), F.col("sources").alias(f"sources_{name}"), F.col("gyms").alias(f"gyms_{name}"))  # noqa: E731, B023
        seen = open_.join(side("i"), "i").join(side("j"), "j").where("root_i <> root_j and not arrays_overlap(sources_i, sources_j)")
        if not conflicts:
            seen = seen.where(_compatible(F.col("gyms_i"), F.col("gyms_j")))
        seen = checkpointed(seen)
        total = seen.count()
        if not total:
            return nodes
        parts = components(seen.select(F.col("root_i").alias("a"), F.col("root_j").alias("b")))
        placed = seen.join(parts, seen["root_i"].cast("string") == parts["node"])
        large = placed.groupBy("component").count().where(F.col("count") > part_edges).select("component")
        some = F.pmod(F.xxhash64("component"), F.lit(-(-total // part_edges)))  # of the parts, together
        small = placed.join(large, "component", "left_anti").select(some.alias("some"), "at.block", "i", "j", *(f"{c}_{x}" for x in "ij" for c in ("root", "sources", "gyms")))
        apart = small.groupBy("some").applyInPandas(lambda frame: _gone_through(frame, conflicts), "root long, into long, s array<string>, g array<string>")
        # of the edges between two clusters the first one speaks for all
        rest = checkpointed(placed.join(large, "component", "left_semi").select("i", "j", "at", F.least("root_i", "root_j").alias("low"), F.greatest("root_i", "root_j").alias("high")))
        joined = nodes.join(checkpointed(apart), "root", "left").select("ord", F.coalesce("into", "root").alias("root"), F.coalesce("s", "sources").alias("sources"), F.coalesce("g", "gyms").alias("gyms"))
        if not rest.take(1):
            return checkpointed(joined)
        ends = rest.select(F.col("low").alias("root"), "at").unionByName(rest.select(F.col("high").alias("root"), "at"))
        first = ends.groupBy("root").agg(F.min("at").alias("at"))
        ready = rest.join(first.withColumnRenamed("root", "low"), ["low", "at"]).join(first.withColumnRenamed("root", "high"), ["high", "at"]).select("low", "high").distinct()
        into = checkpointed(ready.select("low", F.explode(F.array("low", "high")).alias("root")))
        joined = joined.join(into, "root", "left").withColumn("root", F.coalesce("low", "root")).drop("low")
        changed = joined.join(into.select(F.col("low").alias("root")).distinct(), "root", "left_semi")
        sets = changed.groupBy("root").agg(F.array_distinct(F.flatten(F.collect_set("sources"))).alias("s"), F.array_distinct(F.flatten(F.collect_set("gyms"))).alias("g"))  # of one cluster: a row a source
        nodes = checkpointed(joined.join(sets, "root", "left").select("ord", "root", F.coalesce("s", "sources").alias("sources"), F.coalesce("g", "gyms").alias("gyms")))
        open_ = rest.select("i", "j", "at")


def roster_union(rows: DataFrame, *, part_edges: int = 250_000) -> DataFrame:
    """ord and entity (the smallest ord) of roster rows (ord long, names array, source, gym, full boolean).

    Rows that share a name may be one person, never two of one source. Pass A joins rows whose gyms agree; pass B
    those of different gyms, if the names are full ones and no source lists that name twice; pass C rows without a
    gym, if those of that name with one are all one entity by then. Names are compared as given. The candidate
    pairs of a name are those between its sources; rows that are alike in names, source and gym (copies) can't be
    joined with one another and compete for the same partners in order of ord.
    """
    own = rows.select("ord", "source", "gym", "full", F.explode(F.array_distinct("names")).alias("block"))
    w = Window.partitionBy("block")
    own = own.withColumns({"rows": F.count("*").over(w), "sources": F.size(F.collect_set("source").over(w))})
    single = own.select("block", (F.col("rows") == F.col("sources")).alias("single")).distinct()
    a, b = (own.select("block", *(F.col(c).alias(f"{c}_{side}") for c in ("ord", "source", "gym", "full"))) for side in "ij")
    pairs = a.join(b, "block").where("ord_i < ord_j and source_i <> source_j").join(single, "block")
    both = F.col("gym_i").isNotNull() & F.col("gym_j").isNotNull()
    agree = F.col("gym_i").contains(F.col("gym_j")) | F.col("gym_j").contains(F.col("gym_i"))
    tier = F.when(~both, 1).when(agree, 0).otherwise(2)
    edges = checkpointed(pairs.select("block", F.col("ord_i").alias("i"), F.col("ord_j").alias("j"), tier.alias("tier"), "single", (F.col("full_i") & F.col("full_j")).alias("full"), F.struct("block", "ord_i", "ord_j").alias("at")))
    nodes = checkpointed(rows.select("ord", F.col("ord").alias("root"), F.array("source").alias("sources"), F.array_compact(F.array("gym")).alias("gyms")))
    plain = lambda which: edges.where(which).select("i", "j", "at")
    nodes = _contracted(plain("tier = 0"), nodes, conflicts=False, part_edges=part_edges)
    nodes = _contracted(plain("tier = 2 and single and full"), nodes, conflicts=True, part_edges=part_edges)
    with_gym = own.where("gym is not null").join(nodes.select("ord", "root"), "ord").groupBy("block").agg(F.count_distinct("root").alias("roots"))
    settled = edges.where("tier = 1").join(with_gym, "block", "left").where("coalesce(roots, 0) <= 1").select("i", "j", "at")
    return _contracted(settled, nodes, conflicts=False, part_edges=part_edges).select("ord", F.col("root").alias("entity"))


def _told_once(tellings: list[tuple], days: int) -> Iterator[tuple]:
    """The bouts of one pair from its tellings (ord, fighter, opponent, day, event, source, title, event_key) in order of ord."""
    if len(tellings) == 1:
        yield (*tellings[0][:6], tellings[0][6] or None, [])
        return
    fits = lambda a, b: bool(a and b and (a in b or b in a))
    bouts: list[list[tuple]] = []  # the first telling of each leads
    of_day: dict[int, int] = {}  # the bout that a day's tellings belong to
    leads: dict[int, int] = {}  # the bouts whose lead is of that day
    first: dict[str, int] = {}  # the first bout of each event
    for r in tellings:
        if (day := r[3]) is None:
            continue
        if day not in of_day:
            near = [leads[d] for d in range(day - days, day + days + 1) if d in leads]
            of_day[day] = min((k for k in near if fits(bouts[k][0][7], r[7])), default=len(bouts))
        if (k := of_day[day]) == len(bouts):
            leads[day] = k
            first.setdefault(r[7], k)
            bouts.append([])
        bouts[k].append(r)
    undated = [r for r in tellings if r[3] is None]
    of_event = {e: min((k for other, k in first.items() if fits(e, other)), default=None) for e in {r[7] for r in undated}}
    for r in undated:
        k = of_event[r[7]]
        if k is None:
            bouts.append([r])
        else:
            bouts[k].append(r)
    for lead, *rest in bouts:
        rest.sort(key=lambda r: r[0])
        title = next((r[6] for r in (lead, *rest) if r[6]), None)
        yield (*lead[:6], title, [x for x in dict.fromkeys(r[5] for r in rest) if x != lead[5]])


def repeated_bouts(rows: DataFrame, days: int = 1) -> DataFrame:
    """One row for each bout of rows (ord: anything with an order, fighter, opponent, date, event, source, title), with where else it is told.

    Opponents and events are compared as given (normal forms). First, equal days are one bout, told by the first row.
    Then a row up to ``days`` days from an earlier one of that opponent joins it, where one event's name holds the
    other's; a row that has joined another attracts none itself. A row without a date joins the first dated bout of
    that opponent and event, and rows that have none stay. A bout keeps its first dated row's ord, date and event and
    the first title there is. Rows without an opponent are never joined, rows without ord are left out. ``also_from`` lists the other sources.
    """
    event_key = F.lower(F.regexp_replace(F.coalesce("event", F.lit("")), r"\s+", ""))
    clean = rows.where("ord is not null").select("ord", "fighter", "opponent", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "event", "source", "title", event_key.alias("event_key"))
    known = clean.where("opponent is not null").repartition("fighter", "opponent").sortWithinPartitions("fighter", "opponent", "ord")
    types = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    told = ", ".join(f"{c} {types[c]}" for c in ("ord", "fighter", "opponent", "day", "event", "source", "title")) + ", also_from array<string>"

    arrow = to_arrow_schema(StructType.fromDDL(told))
    names, arrow_types = arrow.names, arrow.types

    def gone_through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tellings = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
        bouts = itertools.chain.from_iterable(_told_once(list(own), days) for _, own in itertools.groupby(tellings, key=lambda r: r[1:3]))
        while part := list(itertools.islice(bouts, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), arrow_types, strict=True)], names=names)

    single = clean.where("opponent is null").select("ord", "fighter", "opponent", "day", "event", "source", F.nullif("title", F.lit("")).alias("title"), F.array().cast("array<string>").alias("also_from"))
    found = known.mapInArrow(gone_through, told).unionByName(single)
    return found.select("ord", "fighter", "opponent", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("date"), "event", "source", "title", "also_from")

"""Operator 3: near-duplicates by SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``) as
64-bit hashes; with fewer words the whole sequence is the one shingle; without words it is empty.

1. Signature: for each element a pseudo-random permutation of the signature's places is drawn step by
   step; step j offers ``j + fraction`` at the place drawn. Once no place holds more than j, no later
   step can change it, so a document of many shingles stops after a step or two.
2. Documents with equal sets are one class, and its smallest doc_id stands for it.
3. Bands of ROWS places form buckets. In a bucket the smallest class is the hub; all others are
   compared with it on full sets (size ratios that cannot reach the threshold are left out, exactly).
4. Links become components: tasks run union-find on what they have, then minimum labels spread by
   star contraction until nothing changes.
5. Hubs some of whose partners are not joined to them yet chain to candidate groups, through the partners
   that they share. The members of a group's largest component are joined already; each other member is
   compared with all members, in cells of a block against a block, where a task counts intersections and
   hands on only as many links as join what they join. So nothing is lost, no pair is written out, and a
   group of k copies that resemble their hub costs k comparisons.
   Where a hub has reached all of its partners nothing chains.

A pair at the threshold of 0.85 shares no band with probability (1 - 0.85**ROWS)**BANDS, 2e-9.

Defined cases: null text is empty; a null doc_id cannot be linked and is left out; rows that repeat a
doc_id count as one document (its largest text as a string, so that results are stable); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textblocks import giving_back, hashed_words, mix, mix_int, ranges, text_blocks, trim

SHINGLE_WORDS = 5
BANDS, ROWS = 42, 6
PERCENT = 85  # of the union that the intersection has to reach
PLACES = BANDS * ROWS
WORK = 1 << 17  # shingles whose permutations are held at once
CELL_CLASSES, CELL_SHINGLES = 1024, 1 << 20  # of a block of outliers, which a task holds, about
PASSING_CLASSES, PASSING_SHINGLES = 8192, 1 << 23  # of a block of insiders, which pass by
PASSING_AT_ONCE = 256
BATCH_BYTES = 4 << 20  # of sets that go on together
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each document, joined, and where documents begin."""
    h, first = hashed_words(data, offsets)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[doc]
    full = np.flatnonzero(place + SHINGLE_WORDS <= n[doc])
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(full), np.uint64)
        for k in range(SHINGLE_WORDS):
            rolled = rolled * np.uint64(0xD1342543DE82EF95) + h[full + k]
    short = np.flatnonzero((n > 0) & (n < SHINGLE_WORDS))
    whole = np.array([mix_int(int.from_bytes(h[first[d] : first[d + 1]].tobytes(), "little") % ((1 << 61) - 1) * 8 + int(n[d])) for d in short], np.uint64)
    value = np.concatenate([mix(rolled), whole])
    owner = np.concatenate([doc[full], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(value) else np.zeros(0, bool)
    return value[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: PLACES numbers, the step in the upper bits and a fraction below it."""
    n = np.diff(first)
    out = np.full((len(n), PLACES), np.uint64(2**64 - 1), np.uint64)
    for a, b in _chunks(n):
        _sign(sets[first[a] : first[b]], n[a:b], out[a:b])
    return out


def _chunks(n: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORK, "right")))
        yield a, b
        a = b


def _sign(values: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """Only documents some place of which still exceeds the step take part in it.

    A permutation is held as the swaps that were made: row j of ``moved`` says what stands at j.
    """
    if not len(values):
        return
    doc = np.repeat(np.arange(len(n)), n)
    flat = out.reshape(-1)
    fraction = np.uint64((1 << 56) - 1)
    permutation = None
    rows = np.arange(len(values))
    for step in range(PLACES):
        with np.errstate(over="ignore"):
            drawn = mix(values + np.uint64(step + 1) * _STEP)
        place = step + ((drawn >> np.uint64(40)) % np.uint64(PLACES - step)).astype(np.int64)
        if permutation is None and step == 0:
            chosen = place
            first_draw = place
        else:
            if permutation is None:
                permutation = np.tile(np.arange(PLACES, dtype=np.uint8), (len(values), 1))
                permutation[rows, 0], permutation[rows, first_draw] = first_draw, 0
            chosen = permutation[rows, place].astype(np.int64)
            permutation[rows, place] = permutation[rows, step]
            permutation[rows, step] = chosen
        rank = (np.uint64(step) << np.uint64(56)) | (mix(drawn) & fraction)
        np.minimum.at(flat, doc * PLACES + chosen, rank)
        full = out.max(axis=1) < (np.uint64(step + 1) << np.uint64(56))
        if full.all():
            return
        if full[doc].any():
            go = ~full[doc]
            values, doc = values[go], doc[go]
            rows = np.arange(len(values))
            if not len(values):
                return
            if permutation is None:
                first_draw = first_draw[go]
            else:
                permutation = permutation[go]


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (len(signature), 1))
    for k in range(ROWS):
        h = mix(h ^ parts[:, :, k])
    return h


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (hashes of the whole set), bands; docs has doc_id and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                sets, first = shingles(data, offsets)
                n = np.diff(first)
                some = n > 0
                ends = np.append(0, np.cumsum(sets))[first]
                mixed = np.append(np.uint64(0), np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D))))[first]
                bands = np.zeros((int(some.sum()), BANDS), np.uint64)
                if some.any():
                    bands = band_hashes(signatures(sets, np.append(first[:-1][some], first[-1])))
                at = np.append(0, np.cumsum(np.where(some, BANDS, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array((ends[1:] - ends[:-1]).view(np.int64)),
                        pa.array((mixed[1:] - mixed[:-1]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(giving_back(run), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _set_at(column: pa.Array, row: int) -> np.ndarray:
    """A set within a batch, without a copy."""
    return np.frombuffer(column[row].as_buffer(), np.uint64)


def _dealt(fields: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, text, roles): the fields of each role, the doc_id and its set, in batches of about BATCH_BYTES."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int32() if f in ("role", "i", "j", "side") else pa.int64() for f in fields]
            arrays = [pa.array([r[c] for r in rows], t) for c, t in enumerate([*kinds, pa.int64(), pa.binary()])]
            return pa.RecordBatch.from_arrays(arrays, names=[*fields, "doc_id", "shingles"])

        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                sets, first = shingles(data, offsets)
                for k in range(b - a):
                    own = sets[first[k] : first[k + 1]].tobytes()
                    doc_id = batch.column(0)[a + k].as_py()
                    for r in batch.column(2)[a + k].as_py():
                        rows.append((*(r[f] for f in fields), doc_id, own))
                        size += len(own) + 64
                        if size > BATCH_BYTES:
                            yield out()
                            rows, size = [], 0
            trim()
        if rows:
            yield out()

    return run


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (hub, other) with 100 * intersection >= percent * union of their full sets.

    Each text is read once; its set goes to where its pairs are. A hub's set is sent once to each group
    of its partners, and groups are bounded, so a popular hub is spread over tasks.
    """
    group = F.pmod(F.xxhash64("other"), F.lit(1 << 20))
    degree = pairs.groupBy("hub").agg(F.count("*").alias("degree"))
    split = pairs.join(degree, "hub").withColumn("part", F.pmod(group, F.ceil(F.col("degree") / 64))).drop("degree")
    roles = split.select(F.col("other").alias("doc_id"), "hub", "part", F.lit(1).alias("role")).unionByName(
        split.select(F.col("hub").alias("doc_id"), "hub", "part", F.lit(0).alias("role")).distinct()
    )
    wanted = roles.groupBy("doc_id", F.pmod(F.xxhash64("hub", "part"), F.lit(16)).alias("slice")).agg(F.collect_list(F.struct("hub", "part", "role")).alias("roles"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub_set = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for row, (hub, part, role, doc_id) in enumerate(keys):
                own = _set_at(batch.column(4), row)
                if role == 0:
                    key, hub_set = (hub, part), own.copy()  # it outlives its batch
                    continue
                if key != (hub, part):
                    raise ValueError("a hub's set has to come before its partners'")
                at = np.minimum(np.searchsorted(hub_set, own), len(hub_set) - 1)
                both = int((hub_set[at] == own).sum())
                if 100 * both >= percent * (len(own) + len(hub_set) - both):
                    found.append((hub, doc_id))
            yield _links(found)

    fields = ["hub", "part", "role"]
    texts = docs.join(wanted, "doc_id").select("doc_id", "text", "roles").mapInArrow(giving_back(_dealt(fields)), "hub long, part long, role int, doc_id long, shingles binary")
    return texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(giving_back(compare), "a long, b long")


def _joined(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union-find: each node that isn't the smallest it is joined to, with the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "b"])


def verified_cells(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among members (doc_id, grp, outlier, n) of groups, of pairs with at least one outlier.

    Outliers and insiders of a group are dealt to blocks by hash; a cell is two blocks of outliers, or
    one of outliers and one of insiders.
    """
    size = members.groupBy("grp", "outlier").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    classes, total = F.when(F.col("outlier"), CELL_CLASSES).otherwise(PASSING_CLASSES), F.when(F.col("outlier"), CELL_SHINGLES).otherwise(PASSING_SHINGLES)
    blocks = F.greatest(F.ceil(F.col("k") / classes), F.ceil(F.col("shingles") / total)).cast("int")
    per = size.groupBy("grp").agg(F.max(F.when(F.col("outlier"), blocks)).alias("p"), F.coalesce(F.max(F.when(~F.col("outlier"), blocks)), F.lit(0)).alias("q")).where("p is not null")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("outlier"), F.col("p")).otherwise(F.col("q"))).cast("int")
    upto = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    b, p, q = F.col("block"), F.col("p"), F.col("q")
    # blocks of insiders are numbered after those of outliers
    outlier = F.concat(
        F.transform(upto(b, p + q - 1), lambda j: cell(b, j, 0)),
        F.transform(upto(F.lit(0), b - 1), lambda i: cell(i, b, 1)),
    )
    insider = F.transform(upto(F.lit(0), p - 1), lambda i: cell(i, p + b, 1))
    dealt = members.join(per, "grp").withColumn("block", own).select("doc_id", "grp", F.explode(F.when(F.col("outlier"), outlier).otherwise(insider)).alias("c"))
    roles = dealt.select("doc_id", "grp", "c.*").groupBy("doc_id", F.pmod(F.xxhash64("i", "j"), F.lit(16)).alias("slice")).agg(F.collect_list(F.struct("grp", "i", "j", "side")).alias("roles"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        rows: list[tuple[int, np.ndarray]] = []
        passing: list[tuple[int, np.ndarray]] = []
        block: _Block | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            # a block meets itself once; others pass by it some at a time
            nonlocal block
            if rows and (passing or key[1] == key[2]):
                block = block or _Block(rows)
                yield _links(_joined(block.links(passing or rows, percent)))
            passing.clear()

        for batch in batches:
            for row, (grp, i, j, side, doc_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if (grp, i, j) != key:
                    yield from flush()
                    key, rows, block = (grp, i, j), [], None
                (passing if side else rows).append((doc_id, _set_at(batch.column(5), row).copy()))
                if len(passing) == PASSING_AT_ONCE:
                    yield from flush()
        yield from flush()

    texts = docs.join(roles, "doc_id").select("doc_id", "text", "roles").mapInArrow(giving_back(_dealt(["grp", "i", "j", "side"])), "grp long, i int, j int, side int, doc_id long, shingles binary")
    return texts.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side").mapInArrow(giving_back(compare), "a long, b long")


class _Block:
    """Sets that others are compared with, by marking one set's members among those of all."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.rows = rows
        self.values, self.number = np.unique(np.concatenate([x for _, x in rows]), return_inverse=True)

    def links(self, others: list[tuple[int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
        """Pairs of a set of the block and another whose intersection reaches the share of their union."""
        n = np.array([len(x) for _, x in others])
        flat = np.concatenate([x for _, x in others])
        at = np.minimum(np.searchsorted(self.values, flat), len(self.values) - 1)
        at[self.values[at] != flat] = len(self.values)  # in no set of the block
        starts = np.cumsum(n) - n
        mark = np.zeros(len(self.values) + 1, bool)
        ids = [d for d, _ in others]
        first = 0
        for doc_id, own in self.rows:
            mine = self.number[first : first + len(own)]
            first += len(own)
            mark[mine] = True
            both = np.add.reduceat(mark[at].astype(np.int64), starts)
            mark[mine] = False
            for k in np.flatnonzero(100 * both >= percent * (len(own) + n - both)):
                if ids[k] != doc_id:
                    yield doc_id, ids[k]


def _local_union(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _links(_joined(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b) that has one smaller.

    Each task first runs union-find on its own links. Then large stars and small stars alternate: a
    node's larger neighbours are tied to its smallest one, then its smaller ones, until only stars are
    left. Neighbour minima are aggregates with partial sums, so a node of very many links is no bottleneck.
    """
    links = tables.stored(links.select("a", "b").where("a <> b").mapInArrow(giving_back(_local_union), "a long, b long").distinct())
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        small = tables.stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        # done once every node has one link, to a node that has none to a smaller one
        many = small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chained = small.select(F.col("b").alias("a")).distinct().join(small.select("a"), "a", "left_semi").limit(1)
        links = small
        if not many.select("a").unionByName(chained).take(1):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each distinct doc_id of docs (doc_id, text)."""
    docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")) if repeats(docs) else docs.where("doc_id is not null").select("doc_id", "text")
    sketched = tables.stored(sketch(docs))
    classes = sketched.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    member = tables.stored(sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")))
    head = sketched.join(member.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").where("n_shingles > 0")
    placed = head.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    # buckets of one member have no pair
    crowd = placed.groupBy("band").agg(F.count("*").alias("size"), F.min("doc_id").alias("hub")).where("size > 1")
    stars = tables.stored(placed.join(crowd, "band").where("doc_id <> hub").select("hub", F.col("doc_id").alias("other"), "n").distinct())
    sizes = head.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("hub_n"))
    fits = F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")
    links = tables.stored(verified(docs, stars.join(sizes, "hub").where(fits).select("hub", "other"), percent))
    found = components(links)
    label = found.select(F.col("node").alias("doc_id"), "component")

    def placed_in(groups: DataFrame) -> DataFrame:
        return groups.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def mixed(rows: DataFrame) -> DataFrame:
        # a group of two has been compared, and one of a single component has nothing to join
        counts = rows.groupBy("grp", "component").agg(F.count("*").alias("k")).groupBy("grp")
        return counts.agg(F.max_by("component", F.struct("k", -F.col("component"))).alias("main"), F.sum("k").alias("all"), F.count("*").alias("parts")).where("parts > 1 and all > 2")

    # whoever shares a bucket shares its hub; hubs whose partners are not all joined chain to groups
    stars_of = stars.select(F.col("other").alias("doc_id"), F.col("hub").alias("grp")).unionByName(stars.select(F.col("hub").alias("doc_id"), F.col("hub").alias("grp")).distinct())
    open_ = stars.join(mixed(placed_in(stars_of)).select(F.col("grp").alias("hub")), "hub").select(F.col("hub").alias("a"), F.col("other").alias("b"))
    group = components(open_)
    # a group's smallest member is in no row of its own there
    everyone = placed_in(group.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")).unionByName(group.select(F.col("component").alias("doc_id"), F.col("component").alias("grp")).distinct()))
    members = everyone.join(mixed(everyone), "grp").select("doc_id", "grp", (F.col("component") != F.col("main")).alias("outlier")).join(sizes.select(F.col("hub").alias("doc_id"), F.col("hub_n").alias("n")), "doc_id")
    more = tables.stored(verified_cells(docs, tables.stored(members), percent))
    if more.take(1):
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    joined = member.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def repeats(docs: DataFrame) -> bool:
    """Whether some doc_id is in more than one row."""
    ids = docs.where("doc_id is not null")
    counts = ids.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()
    return bool(counts[0] and counts[0] > 1)

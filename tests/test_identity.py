"""Roster union and repeats of bouts beside going through all rows one after another."""

import collections
import datetime as dt
import random

from boutforge.operators import identity


def united(rows):
    """rows: (ord, names, source, gym, full); every edge in order, pass by pass."""
    rows = sorted(rows)
    by_ord = {r[0]: r for r in rows}
    root = {r[0]: r[0] for r in rows}
    sources, gyms = {r[0]: {r[2]} for r in rows}, {r[0]: {r[3]} - {None} for r in rows}
    blocks = collections.defaultdict(list)
    for r in rows:
        for n in dict.fromkeys(r[1]):
            blocks[n].append(r[0])
    fits = lambda x, y: x == y or x in y or y in x

    def join(i, j, conflicts=False):
        a, b = sorted((root[i], root[j]))
        if a == b or sources[a] & sources[b] or not (conflicts or all(fits(x, y) for x in gyms[a] for y in gyms[b])):
            return
        sources[a] |= sources[b]
        gyms[a] |= gyms[b]
        for k, r in root.items():
            if r == b:
                root[k] = a

    def tier(i, j):
        x, y = by_ord[i][3], by_ord[j][3]
        return 1 if x is None or y is None else 0 if fits(x, y) else 2

    def edges(which):
        return [(n, i, j) for n in sorted(blocks) for i in blocks[n] for j in blocks[n] if i < j and tier(i, j) == which]

    for _, i, j in edges(0):
        join(i, j)
    for n, i, j in edges(2):
        if len(blocks[n]) == len({by_ord[k][2] for k in blocks[n]}) and by_ord[i][4] and by_ord[j][4]:
            join(i, j, True)
    roots = {n: {root[k] for k in own if by_ord[k][3] is not None} for n, own in blocks.items()}
    for n, i, j in edges(1):
        if len(roots[n]) <= 1:
            join(i, j)
    return root


ROSTER = "ord long, names array<string>, source string, gym string, full boolean"


def test_roster_union_equals_going_through_all_edges(spark):
    rng = random.Random(32)
    rows = [(k, [f"n{rng.randrange(25)}" for _ in range(rng.choice([1, 1, 2]))], f"s{rng.randrange(5)}", rng.choice([None, "gym", "gym east", "gym west", "dojo", "hall"]), rng.random() < 0.7) for k in range(160)]
    rows += [(1000 + k, ["same"], "s0", "gym", True) for k in range(40)] + [(2000, ["same"], "s1", "gym", True), (2001, [], "s1", None, True)]
    got = dict(tuple(r) for r in identity.roster_union(spark.createDataFrame(rows, ROSTER)).collect())
    assert got == united(rows)
    assert identity.roster_union(spark.createDataFrame([], ROSTER)).count() == 0


def told_once(rows, days=1):
    """rows: (ord, fighter, opponent, date, event, source, title); dated ones in order of their first telling, then the others."""
    norm = lambda e: "".join((e or "").split()).lower()
    one = lambda a, b: bool(norm(a) and norm(b) and (norm(a) in norm(b) or norm(b) in norm(a)))
    bouts, same = [], {}
    out = {}
    for r in sorted(rows):
        if r[2] is None:
            out[r[0]] = [r]
        elif r[3] is not None:
            if (r[1:4]) in same:
                same[r[1:4]].append(r)
            else:
                same[r[1:4]] = [r]
                bouts.append(same[r[1:4]])
    heads = []
    for group in bouts:
        r = group[0]
        hit = next((h for h in heads if h[0][1:3] == r[1:3] and 0 < abs((h[0][3] - r[3]).days) <= days and one(h[0][4], r[4])), None)
        if hit is None:
            heads.append(group)
            out[r[0]] = group
        else:
            hit += group
    for r in sorted(rows):
        if r[2] is not None and r[3] is None:
            hit = next((h for h in heads if h[0][1:3] == r[1:3] and one(h[0][4], r[4])), None)
            if hit is None:
                out[r[0]] = [r]
            else:
                hit.append(r)
    done = set()
    for head, group in out.items():
        rest = sorted(group[1:])
        lead = group[0]
        titles = [x[6] for x in [lead, *rest] if x[6]]
        done.add((head, lead[3], lead[4], lead[5], titles[0] if titles else None, tuple(s for s in dict.fromkeys(x[5] for x in rest) if s != lead[5])))
    return done


def test_repeats_equal_one_row_after_another(spark):
    rng = random.Random(5)
    start = dt.date(2020, 1, 1)
    events = ["Cup 5", "SPONSOR presents cup5", "Cup", "Other", None, ""]
    rows = [(k, f"f{rng.randrange(3)}", rng.choice(["a", "b", "c", None]), rng.choice([None, *[start + dt.timedelta(days=rng.randrange(12))] * 4]), rng.choice(events), f"s{rng.randrange(4)}", rng.choice([None, "", "title", "final"])) for k in range(300)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "ord long, fighter string, opponent string, date date, event string, source string, title string")
    got = {(r.ord, r.date, r.event, r.source, r.title, tuple(r.also_from)) for r in identity.repeated_bouts(frame).collect()}
    assert got == told_once(rows)
    assert identity.repeated_bouts(frame.limit(0)).count() == 0


def test_roster_of_the_tables(spark):
    from boutforge.plans import identities

    rows = [tuple(r) for r in identities.roster(spark, "/root/testdata/sf0.001").collect()]
    assert dict(tuple(r) for r in identities.roster_entities(spark, "/root/testdata/sf0.001").collect()) == united(rows)

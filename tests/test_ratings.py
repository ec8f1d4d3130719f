"""Ratings, orders and components on small cases with known results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from boutforge.operators import headtohead, rating

D = dt.date


def bouts(spark, rows):
    return spark.createDataFrame(rows, "key string, date date, a string, b string, score_a double, finish boolean")


def test_even_decision_moves_sixteen(spark):
    out = {r.fighter: r for r in rating.states(rating.trace(bouts(spark, [("1", D(2020, 1, 1), "A", "B", 1.0, False)]), rating.Tilt())).collect()}
    assert (out["A"].rating, out["B"].rating) == (1516.0, 1484.0)
    assert (out["A"].wins, out["B"].losses) == (1, 1)


def test_finish_moves_twenty(spark):
    out = {r.fighter: r.rating for r in rating.states(rating.trace(bouts(spark, [("1", D(2020, 1, 1), "A", "B", 0.0, True)]), rating.Tilt())).collect()}
    assert out == {"A": 1480.0, "B": 1520.0}


def plain_replay(rows, tilt):
    state = {}
    for _, _, a, b, s, finish in sorted(rows, key=lambda r: (r[1], r[0])):
        (ra, na), (rb, nb) = state.get(a, (1500.0, 0)), state.get(b, (1500.0, 0))
        k = 40.0 if finish else 32.0

        def new(own, other, other_n, score, k=k):
            m = 1.0
            if score == 1:
                m = tilt.strong_win if other > own else tilt.weak_win
                if other_n < tilt.thin_fights:
                    m *= tilt.thin_win
            elif score == 0:
                m = tilt.strong_loss if other > own else tilt.weak_loss
            return own + k * m * (score - 1 / (1 + 10 ** ((other - own) / 400)))

        state[a], state[b] = (new(ra, rb, nb, s), na + 1), (new(rb, ra, na, 1 - s), nb + 1)
    return state


def test_replay_over_components_matches_one_replay(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        group = rng.choice("XYZ")
        a, b = rng.sample([f"{group}{i}" for i in range(8)], 2)
        rows.append((f"{k:04d}", D(2020, 1, 1) + dt.timedelta(days=rng.randrange(90)), a, b, rng.choice([0.0, 0.5, 1.0]), rng.random() < 0.5))
    want = plain_replay(rows, rating.LIVE)
    got = {r.fighter: (r.rating, r.fights) for r in rating.states(rating.trace(bouts(spark, rows))).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in want)


def test_replay_in_slices_matches_one_replay(spark):
    rng = random.Random(9)
    rows = []
    for k in range(240):
        a, b = rng.sample([f"F{i}" for i in range(12)], 2)
        rows.append((f"{k:04d}", D(2020, 1, 1) + dt.timedelta(days=rng.randrange(120)), a, b, rng.choice([0.0, 0.5, 1.0]), rng.random() < 0.5))
    want = plain_replay(rows, rating.LIVE)
    traced = rating.trace(bouts(spark, rows), slice_bouts=80)
    got = {r.fighter: (r.rating, r.fights) for r in rating.states(traced).collect()}
    assert traced.count() == 480 and got.keys() == want.keys()
    assert all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in want)


def test_pieces_of_one_component_take_no_jobs_of_their_own(spark):
    rng = random.Random(14)
    rows = []
    for k in range(1500):
        # many at once, then one fighter in every bout
        a, b = rng.sample(range(400), 2) if k < 1000 else (0, rng.randrange(1, 400))
        rows.append((f"{k:04d}", D(2020, 1, 1) + dt.timedelta(days=k // 10), f"F{a}", f"F{b}", rng.choice([0.0, 0.5, 1.0]), rng.random() < 0.5))
    frame = bouts(spark, [*rows, ("x", D(2020, 1, 1), "F1", "F2", None, True), ("y", None, "F1", "F2", 1.0, True)]).repartition(5)
    spark.sparkContext.setJobGroup("pieces", "")
    got = rating.states(rating.trace(frame, slice_bouts=60)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pieces"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got, want = {r.fighter: (r.rating, r.fights) for r in got}, plain_replay(rows, rating.LIVE)
    assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in want)
    assert jobs <= 12


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(300)] + [("x", "y")], "a string, b string").repartition(8)
    assert {r.component for r in rating.components(edges).collect()} == {"n000", "x"}


def test_no_one_scores_less_than_anyone_below(spark):
    rows = [("d", f"f{k}", float(r), 0.0, k) for k, r in enumerate([1500, 1490, 1600, 1400, 1700])] + [("e", "g", 1650.0, 2.0, 0)]
    out = rating.pound_for_pound(spark.createDataFrame(rows, "division string, fighter string, rating double, title_value double, n int"), [F.asc("n")], top=2)
    assert {(r.fighter, r.own_score, r.score, r.p4p_rank) for r in out.collect()} == {("f0", 1500.0, 1700.0, 1), ("f1", 1490.0, 1700.0, 2), ("g", 1680.0, 1680.0, 3)}


def test_seeds_are_first_ratings(spark):
    seeds = spark.createDataFrame([("A", 1580.0)], "fighter string, seed double")
    first = rating.trace(bouts(spark, [("1", D(2020, 1, 1), "A", "B", 0.5, False)]), rating.Tilt(), seeds).where("fighter = 'A'").first()
    assert first.before == 1580.0


def test_newest_edges_of_a_cycle_win():
    pairs = [("A", "B", "2020-01-01"), ("B", "C", "2020-02-01"), ("C", "A", "2020-03-01")]
    order = headtohead.consistent_order(["A", "B", "C"], pairs, 3)
    assert order.index("C") < order.index("A") and order.index("B") < order.index("C")


def test_plain_edge_moves_winner_above_within_reach():
    assert headtohead.consistent_order(["A", "B", "C", "D"], [("C", "A", "2020-01-01")], 3) == ["C", "A", "B", "D"]
    assert headtohead.consistent_order(["A", "B", "C", "D", "E"], [("E", "A", "2020-01-01")], 3) == ["A", "B", "C", "D", "E"]


def _reaches(graph: dict[str, set[str]], start: str, goal: str) -> bool:
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        if x == goal:
            return True
        new = graph.get(x, set()) - seen
        seen |= new
        todo += new
    return False


def plain_order(order: list[str], pairs: list[tuple[str, str, str]], reach: int) -> list[str]:
    """consistent_order by looking at everything again at each step."""
    place = {x: k for k, x in enumerate(order)}
    near = [p for p in pairs if p[0] in place and p[1] in place and abs(place[p[0]] - place[p[1]]) <= reach]
    graph: dict[str, set[str]] = {}
    for w, loser, _ in near:
        graph.setdefault(w, set()).add(loser)
    on_cycle = [p for p in near if _reaches(graph, p[1], p[0])]
    plain = [p for p in near if p not in on_cycle]
    kept: dict[str, set[str]] = {}
    for w, loser, _ in plain:
        kept.setdefault(w, set()).add(loser)
    above: dict[str, set[str]] = {x: set() for x in order}
    for w, loser, _ in sorted(on_cycle, key=lambda p: p[2], reverse=True):
        if not _reaches(kept, loser, w):
            kept.setdefault(w, set()).add(loser)
            above[loser].add(w)
    result: list[str] = []
    left = list(order)
    waiting = set(order)
    while left:
        ready = next((x for x in left if not above[x] & waiting), None)
        if ready is None:
            result += left
            break
        result.append(ready)
        left.remove(ready)
        waiting.remove(ready)
    start = {x: k for k, x in enumerate(result)}
    open_ = [p for p in plain if 0 < start[p[0]] - start[p[1]] <= reach]
    for _ in range(len(open_) + 1):
        wrong = [p for p in open_ if result.index(p[0]) > result.index(p[1])]
        if not wrong:
            break
        newest = max(p[2] for p in wrong)
        chosen = next(p for p in wrong if p[2] == newest)
        result.remove(chosen[0])
        result.insert(result.index(chosen[1]), chosen[0])
        open_.remove(chosen)
    return result


def test_order_equals_the_plain_one():
    rng = random.Random(9)
    for n, density, days in [(4, 2, 3), (9, 2, 4), (30, 1, 9), (30, 3, 2), (120, 1, 60), (120, 2, 500)]:
        for _ in range(60):
            order = [f"x{k}" for k in range(n)]
            met = {}
            for _ in range(n * density):
                a = rng.randrange(n)
                b = a + rng.randint(1, 4)
                if b < n:
                    met[a, b] = (order[a], order[b]) if rng.random() < 0.5 else (order[b], order[a])
            pairs = sorted(((w, lo, f"{rng.randrange(days):04d}") for w, lo in met.values()), key=lambda p: (p[2], p[0], p[1]))
            assert headtohead.consistent_order(order, pairs, 3) == plain_order(order, pairs, 3)


def test_long_orders_take_little_time():
    import time

    rng = random.Random(10)
    order = [f"x{k}" for k in range(100_000)]
    pairs = [(order[a], order[b], f"{rng.randrange(4000):04d}") for a in range(99_997) for b in [a + rng.randint(1, 3)] for a, b in [(a, b) if rng.random() < 0.5 else (b, a)]]
    began = time.time()
    assert sorted(headtohead.consistent_order(order, pairs, 3)) == sorted(order)
    assert time.time() - began < 60


def test_pages_by_ranges(spark):
    from boutforge.operators import windows

    rng = random.Random(8)
    rows = [(rng.choice([None, 5, 5, 5, *range(100)]), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "k int, v int")
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for number in (-3, 1, 2, 7, 13, 50, 51, 999):
        for size in (10, 37):
            at = (min(max(1, number), -(-500 // size)) - 1) * size
            got = windows.ranged_page(frame, "k", [F.asc("v")], number, size, ranges=9)
            assert [tuple(r) for r in got.collect()] == ordered[at : at + size], (number, size)
    assert windows.ranged_page(frame.limit(0), "k", [], 3, 10).count() == 0
    assert windows.ranged_page(frame.where("k is null"), "k", [F.asc("v")], 1, 3).count() == 3


def test_cyclic_edges(spark):
    e = spark.createDataFrame([("d", "A", "B"), ("d", "B", "C"), ("d", "C", "A"), ("d", "C", "D"), ("x", "A", "B")], "division string, winner string, loser string")
    found = {tuple(r) for r in headtohead.cyclic(e, ["division"]).select("division", "winner", "loser").collect()}
    assert found == {("d", "A", "B"), ("d", "B", "C"), ("d", "C", "A")}


def test_reorder_leaves_no_direct_contradiction_nearby(spark):
    ranks = spark.createDataFrame([("d", x, k + 1) for k, x in enumerate("ABCDEF")], "division string, fighter string, rank int")
    e = spark.createDataFrame([("d", "C", "B", D(2020, 1, 1)), ("d", "F", "E", D(2020, 1, 2))], "division string, winner string, loser string, date date")
    out = headtohead.reorder(ranks, e).select("division", "fighter", F.col("new_rank").alias("rank"))
    assert headtohead.violations(out, e).count() == 0 and out.count() == 6


def test_order_query_agrees_with_an_order_of_all_edges(spark):
    from boutforge.plans import ratings, registry
    from boutforge.plans.sequences import wins_ranking

    sf = "/root/testdata/sf0.001"
    ranks, edges = {}, {}
    for r in wins_ranking(spark, sf, "2002-01-01").orderBy("division", "rank").collect():
        ranks.setdefault(r.division, []).append(r.fighter)
    for r in ratings._latest(spark, sf).orderBy("date", "winner", "loser").collect():
        edges.setdefault(r.division, []).append((r.winner, r.loser, str(r.date)))
    got = {}
    for r in registry.QUERIES["head_to_head_order"](spark, sf).orderBy("division", "new_rank").collect():
        got.setdefault(r.division, []).append(r.fighter)
    assert got == {d: headtohead.consistent_order(order, edges.get(d, []), 3) for d, order in ranks.items()}


def test_sole_matches_within_days(spark):
    from boutforge.operators import resolve

    rng = random.Random(6)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rng.randrange(200))
    left = [(rng.choice("ab"), k, day()) for k in range(60)] + [("c", 99, D(2020, 1, 1))]
    right = [(rng.choice("ab"), k, day()) for k in range(25)]
    got = resolve.sole_within_days(spark.createDataFrame(left, "f string, x int, d date"), spark.createDataFrame(right, "f string, y int, e date"), ["f"], 3, "d", "e", "x").collect()
    near = {x: [y for g, y, e in right if g == f and abs((e - d).days) <= 3] for f, x, d in left}
    assert {(r.x, r.y) for r in got} == {(x, ys[0]) for x, ys in near.items() if len(ys) == 1}


def test_parts_of_a_change_sum_to_it(spark):
    from boutforge.operators import attribution

    ranking = lambda rows: spark.createDataFrame(rows, "division string, fighter string, rating double, fights int, rank int")
    before = ranking([("d", "a", 1500.0, 4, 1), ("d", "b", 1490.0, 9, 2), ("d", "c", 1480.0, 1, 3), ("d", "same", 1300.0, 5, 4), ("d", "gone", 1200.0, 5, 5)])
    after = ranking([("d", "b", 1520.0, 10, 1), ("d", "a", 1497.0, 4, 2), ("d", "new", 1490.0, 3, 3), ("d", "c", 1480.0, 1, 3), ("d", "same", 1300.0, 5, 4)])
    moves = [("k1", D(2020, 1, 1), "b", "x", 1.0, 1400.0, 1490.0), ("k2", D(2021, 5, 1), "b", "a", 1.0, 1494.004, 1520.0)]
    trace = spark.createDataFrame(moves, "key string, date date, fighter string, opponent string, score double, before double, after double")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "division string, winner string, loser string")
    told = {r.fighter: r for r in attribution.report(before, after, trace, F.lit(D(2021, 1, 1)), pairs(("d", "c", "a")), pairs(("d", "b", "a"))).collect()}
    assert {k: (r.move, r.expired, r.resolved, r.n_new) for k, r in told.items()} == {"a": ("down", 1, 1, 0), "b": ("up", 0, 1, 1), "c": ("same", 1, 0, 0), "new": ("new", 0, 0, 0), "gone": ("dropped", 0, 0, 0)}
    for k in "abc":
        r = told[k]
        assert abs(r.change - (r.bouts_part + r.ripple_part + r.discount_part)) < 1e-9
    assert abs(told["b"].ripple_part - 4.004) < 1e-9 and told["b"].discount_part > 0 and told["a"].ripple_part == -3.0
    assert [(x.opponent, x.result, x.delta) for x in told["b"].new_bouts] == [("a", "win", 26.0)] and told["new"].change is None

"""Findings on larger and odder tables, each on a small case."""

import itertools
import time

import oracle
import pytest
from pyspark.sql import functions as F

from boutforge.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a table into a folder of its own; the query's rows beside those of its SQL there."""

    def beside_sql(name, **frames):
        duck = oracle.duckdb.connect()
        for t, frame in frames.items():
            frame.toPandas().to_parquet(tmp_path / f"{t}.parquet")
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        return oracle.same(registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())

    return beside_sql


def test_titles_keep_what_sql_keeps(spark, tables):
    htmls = [
        '<title>a &quot;b&quot; &#39;c&#39; &amp;lt; &nbsp;</title><a href="x">y</a><A HREF="z">',
        "<TITLE>upper</TITLE>",
        "<title>a<b>c</b></title><title id=1> second\n line </title>",
        "",
    ]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    assert tables("page_links", pages=pages) == ""


def test_many_homonyms_take_little_time(spark):
    from boutforge.operators import linking

    n = 20_000  # of one name on either side: 400 million pairs
    rows = spark.range(n)
    roster = rows.select(F.col("id").cast("string").alias("identity"), F.lit(None).cast("string").alias("site_slug"), F.lit("A B").alias("name"), F.when(F.col("id") == 7, "only gym").when(F.col("id") % 2 == 0, "dojo").alias("gym"))
    bouts = rows.select(F.col("id").alias("bout_id"), F.lit(None).cast("string").alias("site_slug"), F.lit("AB").alias("opponent"), F.when(F.col("id") % 2 == 0, "the only").when(F.col("id") % 3 == 0, "dojo").alias("gym"))
    start = time.monotonic()
    got = {tuple(r) for r in linking.opponents(bouts, roster).groupBy("gym", "resolved", "ambiguous", "n_candidates").count().collect()}
    assert got == {("the only", "7", False, 0, n // 2), ("dojo", None, True, n, 3333), (None, None, True, n, 6667)}
    assert time.monotonic() - start < 60
    one = linking.opponents(bouts.where("bout_id < 4"), roster.where("identity in ('1', '2', '7')")).orderBy("bout_id").collect()
    assert [(r.resolved, r.candidates, r.n_candidates) for r in one] == [("7", None, 0), (None, ["1", "2", "7"], 3), ("7", None, 0), ("2", None, 0)]


def test_long_headlines_are_cut_in_one_pass(spark):
    from boutforge.functions import headlines

    def fitting(text, width):
        return text[: sum(w <= width for w in itertools.accumulate(0.5 if c <= "\xff" else 1 for c in text))]

    texts = ["", "abc", "あ" * 54 + "b" * 9, "éĀ𠀀" * 40, "a" * 109 + "あ", "a" * 110 + "、あ", "い" * 54 + "a、" * 4] + [("あb" * 2000) + str(k) for k in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    start = time.monotonic()
    got = frame.select("t", headlines._prefix_that_fits(F.col("t"), 55).alias("p"), headlines._prefix_that_fits(F.col("t"), 54.5).alias("q"), headlines.summarised(F.col("t")).alias("s")).collect()
    assert time.monotonic() - start < 20
    assert all(r.p == fitting(r.t, 55) and r.q == fitting(r.t, 54.5) for r in got)
    assert {r.s for r in got[7:]} == {fitting("あb" * 40, 54) + "…"}


def test_titles_are_never_sent_to_every_task(spark, monkeypatch):
    from boutforge.operators import resolve

    titles = spark.range(50).select("id", F.concat(F.lit("Ada Bert Caspar "), "id").alias("title"))
    names = spark.range(2000).select(F.concat(F.lit("Bert"), F.when(F.col("id") % 3 > 0, F.concat(F.lit(" Caspar "), "id")).otherwise("")).alias("name"))
    few = resolve.contained(titles, names.distinct(), "title", "name", top=3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(resolve, "SENT_BYTES", 0)
    many = resolve.contained(titles, names.distinct(), "title", "name", top=3)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() > 50


def test_long_chains_of_a_roster_take_few_jobs(spark):
    from test_identity import ROSTER, united

    from boutforge.operators import identity

    # each edge waits for the one before: rounds would be as many as rows
    rows = [(k, [f"n{k:03}", f"n{k + 1:03}"], f"s{k % 3}", "gym", True) for k in range(60)]
    group = "roster-chain"
    spark.sparkContext.setJobGroup(group, group)
    got = dict(tuple(r) for r in identity.roster_union(spark.createDataFrame(rows, ROSTER)).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    assert got == united(rows)
    assert jobs < 120
    assert dict(tuple(r) for r in identity.roster_union(spark.createDataFrame(rows[:5], ROSTER), part_edges=3).collect()) == united(rows[:5])


def test_small_components_are_played_whole(spark):
    import datetime as dt
    import random

    from test_ratings import bouts, plain_replay

    from boutforge.operators import rating

    rng = random.Random(8)
    pairs = [(c, *rng.sample(range(4), 2)) for c in range(30) for _ in range(10)]
    rows = [(f"{k:04}", dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(60)), f"f{c}-{x}", f"f{c}-{y}", rng.choice([1.0, 0.0, 0.5]), rng.random() < 0.5) for k, (c, x, y) in enumerate(pairs)]
    group = "small-components"
    spark.sparkContext.setJobGroup(group, group)
    states = {r.fighter: (r.rating, r.fights) for r in rating.states(rating.trace(bouts(spark, rows), slice_bouts=20)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    want = plain_replay(rows, rating.LIVE)
    assert states.keys() == want.keys() and all(abs(states[f][0] - want[f][0]) < 1e-9 for f in want)
    assert jobs < 60
    # one component of many bouts beside them is sliced
    more = rows + [(f"x{k:04}", dt.date(2020, 1, 1) + dt.timedelta(days=k), "big", f"other{k % 3}", 1.0, False) for k in range(60)]
    want = plain_replay(more, rating.LIVE)
    states = {r.fighter: r.rating for r in rating.states(rating.trace(bouts(spark, more), slice_bouts=20)).collect()}
    assert states.keys() == want.keys() and all(abs(states[f] - want[f][0]) < 1e-9 for f in want)


def test_layouts_are_found_once_for_a_block(spark):
    from boutforge.sources import sections

    # one paragraph of very many pieces in each section
    many = "<b>x</b>y" * 400
    html = "".join(f'<h2 class="article-heading">{k}</h2><p>{many}<span style="font-weight:bold">（WIN）<a href="1">A{k}</a> vs. <a href="2">B{k}</a>（LOSE）</span>1R</p>' for k in range(60))
    start = time.monotonic()
    rows = sections.bouts(sections.blocks(spark.createDataFrame([(1, html)], "page int, html string"), "page", "html"), "page").collect()
    assert time.monotonic() - start < 30
    assert {(r.heading, r.layout, r.a, r.b, r.mark_b) for r in rows} == {(str(k), "a", f"A{k}", f"B{k}", "LOSE") for k in range(60)}


def test_repeats_take_one_pass(spark):
    import datetime as dt

    from test_identity import told_once

    from boutforge.operators import identity

    # each day waits for the one before: rounds would be as many as days
    start = dt.date(2020, 1, 1)
    rows = [(k, "f", "o", start + dt.timedelta(days=k), "Cup", f"s{k % 3}", "") for k in range(60)] + [(900 + k, "f", o, None, e, "web", "t") for k, (o, e) in enumerate([("o", "cup 1"), ("o", "x"), (None, "Cup"), ("p", None)])]
    group = "repeats-chain"
    spark.sparkContext.setJobGroup(group, group)
    frame = spark.createDataFrame(rows, "ord long, fighter string, opponent string, date date, event string, source string, title string")
    got = {(r.ord, r.date, r.event, r.source, r.title, tuple(r.also_from)) for r in identity.repeated_bouts(frame).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    assert got == told_once(rows)
    assert jobs < 10


def test_pieces_of_labels_are_found_once(spark):
    from boutforge.functions import results

    texts = {"延長1R 判定 30-29": "判定 30-29", "12分30R3分10秒 KO": "3分10秒 KO", "1R 再延長2R終了 判定": "再延長R終了 判定", "KO + 延長R": "不明", "+再延長 3R終了時 判定": "再延長R 判定", "1 2R KO": "不明", "再戦 KO": "不明", "(3R) 判定勝ち": "判定勝ち", "相手の負傷による棄権": "相手の負傷による棄権", "": "—"}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in frame.select("t", results.method_label(F.col("t")).alias("v")).collect()} == texts
    plan = frame.select(results.method_label(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2


def test_boxes_find_each_text_once_in_all_tasks(spark):
    rows = registry.QUERIES["customer_boxes"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("総合格闘技") == 1


@pytest.mark.parametrize("name", ["head_to_head", "opponent_standing_as_of"])
def test_tasks_grow_with_the_rows(spark, monkeypatch, name):
    from boutforge.plans import testdata

    sf = "/root/testdata/sf0.001"
    few = sorted(map(tuple, registry.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(testdata, "ROWS", 500, raising=False)
    many = registry.QUERIES[name](spark, sf)
    assert many.rdd.getNumPartitions() >= 2 * spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500
    assert sorted(map(tuple, many.collect())) == few


def test_record_templates_take_one_worker_for_a_task(spark):
    from boutforge.sources import feeds, pages

    rows = registry.QUERIES["japanese_record_pages"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    # more blocks than go into a batch, odd nesting, an unclosed block, no text
    many = "{{Fight-cont|○|甲|KO|大会|2020年1月2日}}" * (feeds.ROWS + 5)
    texts = [(1, many), (2, None), (3, "{{Fight-cont|×|[[a|b]]<ref>|{{x}}</ref>|{{small|判定|{{y}}}}|{{{c}}}|d|2021年1月2日"), (4, "")]
    made = feeds.templates(spark.createDataFrame(texts, "`the key` int, t string"), "t", "{{Fight-cont", [r"(?is)<ref[^>]*>.*?</ref>"])
    got = {(r["the key"], r["place"]): r["p"] for r in made.collect()}
    assert {k: len([x for x in got if x[0] == k]) for k in (1, 2, 3, 4)} == {1: feeds.ROWS + 5, 2: 0, 3: 1, 4: 0}
    assert got[1, feeds.ROWS + 4] == ["Fight-cont", "○", "甲", "KO", "大会", "2020年1月2日"]
    assert got[3, 0] == ["Fight-cont", "×", "[[a|b]]", "{{small|判定|{{y}}}}", "{{{c}}}", "d", "2021年1月"]
    assert pages.fight_rows(spark.createDataFrame(texts[:2], "page int, t string"), "t").where("result = 'win' and date = '2020-01-02'").count() == feeds.ROWS + 5


def test_only_edges_of_near_places_are_ordered(spark):
    import datetime as dt
    import random

    from boutforge.operators import headtohead

    rng = random.Random(15)
    names = {d: rng.sample([f"f{k:03}" for k in range(80)], 60) for d in "xy"}
    ranks = spark.createDataFrame([(d, f, k + 1) for d, own in names.items() for k, f in enumerate(own)], "division string, fighter string, rank int")
    two = lambda own, k: rng.sample(own if rng.random() < 0.4 else own[k % 56 : k % 56 + 5], 2)
    rows = [(d, *two(names[d], k), dt.date(2020, 1, 1 + rng.randrange(9)), k) for d in "xy" for k in range(300)] + [("x", "gone", names["x"][0], dt.date(2020, 1, 1), 999)]
    edges = spark.createDataFrame(rows, "division string, winner string, loser string, date date, n long")
    latest = {}
    for r in sorted(edges.collect(), key=lambda r: (r.date, -r.n)):
        latest[r.division, frozenset((r.winner, r.loser))] = r
    want = {d: headtohead.consistent_order(own, [(r.winner, r.loser, str(r.date)) for r in sorted(latest.values(), key=lambda r: (r.date, r.winner, r.loser)) if r.division == d], 3) for d, own in names.items()}
    got = headtohead.reorder(ranks, edges, tie="n").orderBy("division", "new_rank").collect()
    assert {d: [r.fighter for r in got if r.division == d] for d in "xy"} == want and want["x"] != names["x"]


def test_order_joins_items_and_orders_twice(spark, monkeypatch):
    from boutforge.plans import sequences, testdata

    asked = []
    monkeypatch.setattr(sequences, "bouts", lambda *a: asked.append(a) or testdata.bouts(*a), raising=False)
    group = "order-of-all"
    spark.sparkContext.setJobGroup(group, group)
    registry.QUERIES["head_to_head_order"](spark, "/root/testdata/sf0.001").collect()
    spark.sparkContext.setJobGroup("other", "other")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert len(asked) == 2 and len(stages) < 60


def test_calendars_hand_over_only_texts(spark):
    from boutforge.sources import sections

    assert sections.blocks(spark.createDataFrame([(1, "<p>a")], "page int, html string"), "page", "html", ["n", "text"]).columns == ["page", "n", "text"]
    plan = registry.QUERIES["calendar_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "pieces" not in plan and plan.count("regexp_extract(") <= 3
    lines = {
        "2024年5月6日(月) A @ B": ("2024-05-06", "A", "B"),
        "2024.05.06 A＠ B C": ("2024-05-06", "A", "B C"),
        " 2024 / 5 / 6 A <br> x": ("2024-05-06", "A x", None),
        "2024-5-6（土）": ("2024-05-06", "（土）", None),
        "2024年2月30日 A": None,
        "2024-13-1 A": None,
        "x 2024-1-1 A": None,
        "2024-1-1": None,
        "2024-1-12": ("2024-01-01", "2", None),
        "　2024年1月1日　（日）　B　＠　": ("2024-01-01", "B", "　"),
    }
    page = spark.createDataFrame([(k, f"<ul><li>{t}</ul>") for k, t in enumerate(lines)], "page int, html string")
    got = {r.page: (str(r.date), r.title, r.venue) for r in sections.calendar(sections.blocks(page, "page", "html", ["n", "text"]), "page").collect()}
    assert got == {k: v for k, v in enumerate(lines.values()) if v}


def test_changes_of_a_ranking_pass_over_bouts_twice(spark):
    import datetime as dt
    import random

    from boutforge.operators import attribution

    plan = registry.QUERIES["rank_attribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") > 0 and plan.count("lineitem.parquet") + plan.count("Relation [l_orderkey") <= 2
    rng = random.Random(17)
    rows = [(rng.choice("xy"), *rng.sample("abcde", 2), dt.date(2020, 1, 1 + rng.randrange(20)), k) for k in range(120)]
    edges = spark.createDataFrame(rows, "division string, winner string, loser string, date date, n long")

    def held(day):
        latest = {}
        for r in sorted((r for r in rows if r[3] <= day), key=lambda r: (r[3], -r[4])):
            latest[r[0], frozenset(r[1:3])] = r[:3]
        return spark.createDataFrame(list(latest.values()), "division string, winner string, loser string")

    since, now = dt.date(2020, 1, 6), dt.date(2020, 1, 17)
    want = {tuple(r) for r in attribution.edge_changes(held(since), held(now)).collect()}
    got = {tuple(r) for r in attribution.edge_changes_between(edges, F.lit(since), F.lit(now), "n").collect()}
    assert got == want and any(r[2] for r in got)


def test_cards_move_once(spark):
    import random

    from boutforge.operators import linking

    query = registry.QUERIES["card_changes"](spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rng = random.Random(19)
    bouts = lambda: [(c, *rng.sample("ABCDEF", 2)) for c in range(60) for _ in range(rng.randrange(7))]
    mine, theirs = bouts(), [*bouts(), (99, "A", "B"), (99, "B", "A")]
    pairs = lambda rows: {(c, "|".join(sorted(ab))) for c, *ab in rows}
    gone, new = pairs(mine) - pairs(theirs), pairs(theirs) - pairs(mine)
    shares = lambda x, y: bool(set(x.split("|")) & set(y.split("|")))
    first: dict = {}
    for c, old in sorted(gone):
        found = sorted(n for d, n in new if d == c and shares(old, n))
        if found:
            first.setdefault((c, found[0]), old)
    changed = {(c, old, n, "changed") for (c, n), old in first.items()}
    want = changed | {(c, p, None, "removed") for c, p in gone if (c, p) not in {r[:2] for r in changed}} | {(c, None, p, "added") for c, p in new if (c, p) not in first}
    frame = lambda rows: spark.createDataFrame(rows, "card int, a string, b string")
    got = [tuple(r) for r in linking.card_changes(frame(mine), frame(theirs), ["card"]).select("card", "old", "new", "change").collect()]
    assert set(got) == want and len(got) == len(want) and len({r[3] for r in got}) == 3


def test_standing_is_told_for_all_wins(spark, tables):
    import datetime as dt

    day = lambda text: dt.date.fromisoformat(text)
    columns = "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_shipdate date, l_tax double, l_returnflag string, l_linestatus string, l_quantity double"
    told = [(1, 1, 7, "1995-02-01", "R"), (1, 2, 7, "1996-03-01", "A"), (2, 1, 7, "1996-03-01", "A"), (2, 2, 8, "2001-07-01", "R"), (1, 3, 8, "2001-07-02", "A"), (1, 3, 8, "2001-07-02", "A")]
    lines = [(o, n, s, 10.0, day(d), 0.01, flag, "F", 5.0) for o, n, s, d, flag in told] + [(2, 3, 7, 10.0, None, 0.01, "A", "F", 5.0)]
    orders = spark.createDataFrame([(1, 5, "1-URGENT"), (2, 6, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string")
    lineitem = spark.createDataFrame(lines, columns)
    assert tables("opponent_standing_as_of", lineitem=lineitem, orders=orders) == ""
    wins = lambda year: registry.QUERIES["opponent_standing_as_of"](spark, "/root/testdata/sf0.001").join(dated, "bout_id").where(F.year("date") == year).count()
    from boutforge.plans.testdata import bouts

    dated = bouts(spark, "/root/testdata/sf0.001").select("bout_id", "date")
    assert all(wins(year) for year in (1996, 2000, 2001))

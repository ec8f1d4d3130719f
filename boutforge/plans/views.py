"""Lists, labels and comparisons as readers see them, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import views
from .registry import query
from .sequences import ranks_sql, wins_ranking
from .testdata import AS_OF, BOUTS_SQL, sides, table


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, CAST(1500 + 10 * count(*) FILTER (WHERE result = 'win') AS DOUBLE) AS rating, count(*) AS fights, max(date) AS last_date FROM sides GROUP BY fighter)
SELECT fighter, rating, CASE WHEN datediff('day', last_date, DATE '{AS_OF}') // 180 <= 0 THEN rating ELSE greatest(CAST(1400 AS DOUBLE), rating) END AS shown_rating FROM r WHERE fighter LIKE 'C%'""")
def publishable_ratings(spark, sf_dir):
    s = sides(spark, sf_dir)
    states = s.groupBy("fighter").agg((1500 + 10 * F.count(F.when(F.col("result") == "win", 1))).cast("double").alias("rating"), F.count("*").alias("fights"), F.max("date").alias("last_date"))
    records = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("fighter"))
    return views.publishable(states, records, F.lit(AS_OF).cast("date")).select("fighter", "rating", "shown_rating")


@query(f"""{BOUTS_SQL}, {ranks_sql("top", "2000-01-01")}, st AS (SELECT DISTINCT fighter, date FROM (SELECT fighter, date, count(*) OVER (PARTITION BY fighter ORDER BY date RANGE UNBOUNDED PRECEDING) AS n FROM sides) WHERE n >= 20)
SELECT DISTINCT s.fighter FROM sides s JOIN (SELECT * FROM top WHERE rank <= 50) t ON t.division = s.division AND t.fighter = s.opponent JOIN st ON st.fighter = s.opponent AND st.date = s.date WHERE result = 'win' AND NOT opener AND year(s.date) = 2000""")
def ranker_win_exemptions(spark, sf_dir):
    s = sides(spark, sf_dir)
    so_far = Window.partitionBy("fighter").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    standing = s.select("fighter", "date", F.count("*").over(so_far).alias("n")).where("n >= 20").select("fighter", "date").distinct()
    return views.ranker_wins(s, wins_ranking(spark, sf_dir, "2000-01-01").where("rank <= 50"), standing, 2000)


@query(f"""{BOUTS_SQL}, {ranks_sql("top", "2001-06-01")}, ch AS (SELECT division, fighter FROM top WHERE rank = 3), rest AS (SELECT division, fighter, CAST(row_number() OVER (PARTITION BY division ORDER BY rank) AS INTEGER) AS rank, false AS champion FROM top WHERE (division, fighter) NOT IN (SELECT (division, fighter) FROM ch)),
u AS (SELECT * FROM rest UNION ALL SELECT division, fighter, 0, true FROM ch)
SELECT division, fighter, rank, champion, CASE WHEN champion THEN '王者' WHEN rank <= 15 AND division <> '5-LOW' THEN rank || '位' END AS label FROM u""")
def champions_and_labels(spark, sf_dir):
    """The third of each division is its champion; one division isn't published."""
    ranked = wins_ranking(spark, sf_dir, "2001-06-01").select("division", "fighter", "rank")
    both = views.with_champions(ranked, ranked.where("rank = 3"))
    shown = [r[0] for r in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect() if r[0] != "5-LOW"]  # five priorities
    return views.rank_labels(both, shown)


@query(f"""{BOUTS_SQL}, {ranks_sql("cur", "2001-06-01")}, {ranks_sql("prv", "2000-06-01")} SELECT c.division, c.fighter, c.rank, CASE WHEN p.rank IS NULL OR p.rank > 15 THEN 'NEW' WHEN p.rank > c.rank THEN '▲' || (p.rank - c.rank) WHEN p.rank < c.rank THEN '▼' || (c.rank - p.rank) ELSE '—' END AS move FROM cur c LEFT JOIN prv p ON c.division = p.division AND c.fighter = p.fighter""")
def rank_moves(spark, sf_dir):
    return views.moves(wins_ranking(spark, sf_dir, "2001-06-01").select("division", "fighter", "rank"), wins_ranking(spark, sf_dir, "2000-06-01"), ["division", "fighter"]).select("division", "fighter", "rank", "move")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '【org フライ級】新王者N' || o_custkey || 'が誕生。' WHEN 1 THEN '【org フライ級】王座が空位に(前王者:N' || o_custkey || ')。' WHEN 2 THEN '【org フライ級】N' || o_custkey || 'が5位→3位に上昇。' WHEN 3 THEN '【org フライ級】N' || o_custkey || 'が3位→5位に後退。' WHEN 4 THEN '【org フライ級】N' || o_custkey || 'がランクイン(9位)。' ELSE '【org フライ級】N' || o_custkey || 'がランク外に(前回9位)。' END AS line FROM orders""")
def change_lines(spark, sf_dir):
    n = F.col("o_orderkey") % 6
    kinds = ["champion", "vacated", "up", "down", "new", "dropped"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (n + 1).cast("int"))
    line = views.change_text(F.lit("org"), F.lit("フライ級"), F.concat(F.lit("N"), "o_custkey"), kind, F.element_at(F.array(*map(F.lit, [0, 1, 5, 3, 0, 9])), (n + 1).cast("int")), F.element_at(F.array(*map(F.lit, [1, 0, 3, 5, 9, 0])), (n + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("""WITH c AS (SELECT c_custkey AS fighter, c_acctbal AS rating, 'v' || (c_custkey % 2) AS version FROM customer), p AS (SELECT c_custkey AS fighter, c_acctbal * 0.9 AS rating, 'v1' AS version FROM customer WHERE c_custkey % 7 > 0)
SELECT c.fighter, CASE WHEN p.rating IS NOT NULL AND p.version = c.version THEN floor(c.rating - p.rating + 0.5) END AS delta FROM c LEFT JOIN p USING (fighter)""")
def rating_deltas(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fighter"), F.col("c_acctbal").alias("rating"), F.concat(F.lit("v"), F.col("c_custkey") % 2).alias("version"))
    p = c.where("fighter % 7 > 0").select("fighter", (F.col("rating") * 0.9).alias("rating"), F.lit("v1").alias("version"))
    return views.rating_deltas(c, p, ["fighter"]).select("fighter", F.col("delta").cast("double").alias("delta"))


@query(f"""{BOUTS_SQL}, p AS (SELECT DISTINCT fighter AS a, 'S' || ((CAST(substr(fighter, 2) AS INTEGER) % 10) + 1) AS b FROM sides WHERE fighter LIKE 'C%'), f AS (SELECT fighter, arg_max(org, (date, bout_id)) AS org, arg_max(division, (date, bout_id)) AS division FROM sides GROUP BY fighter), d AS (SELECT DISTINCT fighter, opponent FROM sides)
SELECT a, b FROM p WHERE EXISTS (SELECT 1 FROM f x, f y WHERE x.fighter = a AND y.fighter = b AND x.org = y.org AND x.division = y.division) OR EXISTS (SELECT 1 FROM d WHERE fighter = a AND opponent = b) OR EXISTS (SELECT 1 FROM d x JOIN d y ON x.opponent = y.opponent WHERE x.fighter = a AND y.fighter = b)""")
def comparable_pairs(spark, sf_dir):
    s = sides(spark, sf_dir)
    pairs = s.where("fighter like 'C%'").select(F.col("fighter").alias("a"), F.concat(F.lit("S"), F.substr("fighter", F.lit(2)).cast("int") % 10 + 1).alias("b")).distinct()
    latest = F.struct("date", "bout_id")
    return views.comparable(pairs, s.groupBy("fighter").agg(F.max_by("org", latest).alias("org"), F.max_by("division", latest).alias("division")), s)


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, count(*) AS n FROM sides WHERE org = 'org1' AND result <> 'nc' GROUP BY fighter), m AS (SELECT fighter, count(*) AS n FROM sides WHERE result <> 'nc' AND date > DATE '2000-01-01' GROUP BY fighter)
SELECT 'C' || c_custkey AS fighter FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' AND ('C' || c_custkey IN (SELECT fighter FROM r) OR 'C' || c_custkey IN (SELECT fighter FROM m))""")
def visible_fighters(spark, sf_dir):
    s = sides(spark, sf_dir)
    n = lambda r: F.count(F.when(F.col("result") == r, 1))
    record = lambda rows: rows.groupBy("fighter").agg(n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"))
    f = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("fighter"), (F.col("c_acctbal") < 0).alias("hidden"), (F.col("c_mktsegment") == "MACHINERY").alias("delisted"))
    return views.visible(f, record(s.where("org = 'org1'")), record(s.where("date > '2000-01-01'"))).select("fighter")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 20 AND c_name LIKE '%1%'")
def faceted_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tags = F.when(F.col("c_nationkey") < 20, F.array(F.lit("low"))).otherwise(F.array(F.lit("high")))
    f = c.select("c_custkey", F.col("c_mktsegment").alias("weight_class"), tags.alias("tags"), F.lit("").alias("name"), F.col("c_name").alias("name_en"))
    return views.searched(f, weight_class="BUILDING", tag="low", text="1").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(replace(p_name, ' ', '')), 'widget') OR contains(lower(replace(p_type, ' ', '')), 'widget') ORDER BY p_name, p_partkey LIMIT 60")
def paged_search(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.struct("p_name", "p_partkey").alias("name"))
    return views.looked_up(part, " WID get", ["p_name", "p_type"], page=2).select("p_partkey")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY year DESC")
def event_years(spark, sf_dir):
    return views.years_of(table(spark, sf_dir, "orders"), "o_orderdate")


@query(f"""{BOUTS_SQL}, {ranks_sql("top", "2001-06-01")} SELECT division, fighter, rank FROM top WHERE rank <= 15""")
def public_ranking(spark, sf_dir):
    """What leaves the house has no rating."""
    view = wins_ranking(spark, sf_dir, "2001-06-01").where("rank <= 15").select("division", "fighter", "rank", F.lit(1500.0).alias("rating"), F.lit(1500.0).alias("raw_rating"))
    return views.without_ratings(view)


@query(f"""{BOUTS_SQL}, {ranks_sql("top", "2001-06-01")}, d AS (SELECT fighter, count(*) AS defences FROM sides WHERE opener AND result = 'win' GROUP BY fighter) SELECT t.fighter, t.division, d.defences, d.defences IS NULL AS issue FROM top t LEFT JOIN d USING (fighter) WHERE rank <= 5""")
def champion_issues(spark, sf_dir):
    s = sides(spark, sf_dir)
    top = wins_ranking(spark, sf_dir, "2001-06-01").withColumn("rating", F.lit(0.0))
    defences = s.where("opener and result = 'win'").groupBy("fighter").agg(F.count("*").alias("defences"))
    _, champions = views.candidates(top, [], top.where("rank <= 5").select("fighter", "division"), defences)
    return champions


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_returnflag = 'A' THEN 'win' ELSE 'loss' END ELSE CASE WHEN l_linenumber = 1 THEN 'draw' WHEN l_linenumber = 2 THEN 'nc' END END AS result FROM lineitem WHERE (l_returnflag <> 'N' OR l_linenumber <= 2) AND l_quantity < 45")
def record_rows(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") != "N", "decisive").when(F.col("l_linenumber") == 1, "draw").when(F.col("l_linenumber") == 2, "nc").otherwise("cancelled")
    rows = items.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 45, F.col("l_shipdate")).alias("date"), kind.alias("result_type"), (F.col("l_returnflag") == "A").alias("is_win"))
    return views.bout_rows(rows).select("l_orderkey", "l_linenumber", "result")


@query("""WITH e AS (SELECT p_brand AS class, CASE p_size % 5 WHEN 0 THEN '王者' WHEN 1 THEN '暫定王者' ELSE CAST(p_size AS VARCHAR) END AS rank, CASE WHEN p_partkey % 10 > 0 THEN p_type || p_partkey END AS name FROM part), n AS (SELECT p_type || p_partkey AS name, p_partkey AS slug FROM part WHERE p_partkey % 3 = 0)
SELECT class, e.rank, e.name, coalesce(n.slug, 0) AS slug, CAST(row_number() OVER (PARTITION BY class ORDER BY CASE WHEN rank = '王者' THEN -2 WHEN contains(rank, '暫定') THEN -1 ELSE CAST(rank AS INTEGER) END, e.name) AS INTEGER) AS place FROM e LEFT JOIN n ON n.name = replace(e.name, ' ', '') WHERE e.name IS NOT NULL""")
def finished_classes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat("p_type", "p_partkey")
    rank = F.when(F.col("p_size") % 5 == 0, "王者").when(F.col("p_size") % 5 == 1, "暫定王者").otherwise(F.col("p_size").cast("string"))
    entries = part.select(F.col("p_brand").alias("class"), rank.alias("rank"), F.when(F.col("p_partkey") % 10 > 0, name).alias("name"))
    return views.finished_classes(entries, part.where("p_partkey % 3 = 0").select(name.alias("name"), F.col("p_partkey").alias("slug"))).select("class", "rank", "name", F.coalesce("slug", F.lit(0)).alias("slug"), "place")


@query("SELECT count(*) AS ranked, count(*) FILTER (WHERE NOT v) AS with_champion FROM (SELECT p_brand, bool_or(p_size = 50) AS v FROM part GROUP BY p_brand)")
def class_counts(spark, sf_dir):
    return views.class_counts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("class"), F.when(F.col("p_size") == 50, "空位").otherwise("1").alias("rank"), F.col("p_name").alias("name")))


@query("""WITH r AS (SELECT p_partkey, p_size * 2 AS fa, p_partkey % 100 AS fb FROM part)
SELECT p_partkey, CASE WHEN fa >= 70 THEN 'Aのフィニッシュ率は' || fa || '%と非常に高い' || ' ' ELSE '' END || CASE WHEN 100 - fa >= 50 THEN 'Aは判定決着が' || (100 - fa) || '%を占める' || ' ' ELSE '' END || CASE WHEN fb >= 70 THEN 'Bのフィニッシュ率は' || fb || '%と非常に高い' || ' ' ELSE '' END || CASE WHEN fb >= 60 THEN 'Bは一本勝ちの比率が' || fb || '%を占め、サブミッション色が強い' || ' ' ELSE '' END
 || CASE WHEN abs(fa - fb) >= 30 THEN '両者のフィニッシュ率には' || abs(fa - fb) || 'ポイントの差がある(A' || fa || '% / B' || fb || '%) ' ELSE '' END AS points FROM r""")
def notable_points(spark, sf_dir):
    fa, fb = (F.col("p_size") * 2).cast("int"), (F.col("p_partkey") % 100).cast("int")
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.lit("A").alias("name_a"), F.lit("B").alias("name_b"), fa.alias("finish_a"), fb.alias("finish_b"), (100 - fa).alias("decision_a"), F.lit(0).alias("decision_b"), F.lit(0).alias("sub_a"), fb.alias("sub_b"))
    return views.notable(pairs).select("p_partkey", F.concat(F.array_join("points", " "), F.when(F.size("points") > 0, " ").otherwise("")).alias("points"))


@query("""WITH b AS (SELECT 'C' || o_custkey AS fighter, CASE o_orderkey % 7 WHEN 0 THEN 'win' WHEN 1 THEN 'loss' WHEN 2 THEN 'draw' WHEN 3 THEN 'scheduled' WHEN 4 THEN 'unknown' WHEN 5 THEN 'no_contest' ELSE 'cancelled' END AS result, CASE WHEN o_orderstatus = 'P' THEN 'walkover' END AS method FROM orders)
SELECT fighter, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE result = 'draw') AS draws, count(*) FILTER (WHERE result = 'unknown') AS unknown, count(*) AS total FROM b WHERE coalesce(method, '') <> 'walkover' AND result IN ('win', 'loss', 'draw', 'unknown') GROUP BY fighter""")
def kick_records(spark, sf_dir):
    results = ["win", "loss", "draw", "scheduled", "unknown", "no_contest", "cancelled"]
    b = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("fighter"), F.element_at(F.array(*map(F.lit, results)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("result"), F.when(F.col("o_orderstatus") == "P", "walkover").alias("method"))
    return views.kick_records(b)


@query("""WITH d AS (SELECT o_custkey AS key, count(*) AS total FROM orders GROUP BY 1), s AS (SELECT c_custkey AS key, c_nationkey AS stated_total FROM customer)
SELECT s.key, CASE WHEN d.total IS NULL THEN 'missing' WHEN stated_total = total THEN 'full' WHEN stated_total < total THEN 'larger' WHEN stated_total - total <= 2 THEN 'within' ELSE 'smaller' END AS status FROM s LEFT JOIN d USING (key)""")
def stated_totals(spark, sf_dir):
    derived = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("total"))
    stated = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("stated_total"))
    return views.against_stated(derived, stated, tolerance=2).select("key", "status")


@query("""WITH s AS (SELECT o_orderpriority AS grp, o_orderkey AS key, o_custkey AS fighter, o_totalprice < 50000 AS outside FROM orders), k AS (SELECT s.*, o.o_orderkey IS NOT NULL AS captured, l.c_custkey IS NOT NULL AS listed FROM s LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = s.key LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) l ON l.c_custkey = s.fighter)
SELECT grp AS "group", count(*) FILTER (WHERE captured) AS captured, count(*) FILTER (WHERE NOT captured AND outside) AS out_of_scope, count(*) FILTER (WHERE NOT captured AND NOT outside AND NOT listed) AS a, count(*) FILTER (WHERE NOT captured AND NOT outside AND listed) AS c FROM k GROUP BY grp""")
def coverage_classes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sample = o.select(F.col("o_orderpriority").alias("group"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("fighter"), "o_totalprice")
    listed = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("fighter"))
    return views.coverage(sample, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), F.col("o_totalprice") < 50000, listed)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderkey % 2 = 0 AS expected FROM orders WHERE o_orderdate >= DATE '2001-06-01' - 120 AND o_orderdate < DATE '2001-06-01' - 10 AND o_orderstatus <> 'F'""", dates=("date",))
def coverage_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus")
    return views.coverage_gaps(o, o.where("o_orderstatus = 'F'"), ["o_orderkey"], F.lit("2001-06-01").cast("date"), window=120, grace=10, known=o.where("o_orderkey % 2 = 0")).select("o_orderkey", "date", "expected")


@query(f"""{BOUTS_SQL}, {ranks_sql("top", "2001-06-01")}, p AS (SELECT DISTINCT division, a AS above, b AS below FROM bouts WHERE quantity = 50), t AS (SELECT p.*, x.rank AS above_rank, y.rank AS below_rank FROM p LEFT JOIN top x ON x.division = p.division AND x.fighter = above LEFT JOIN top y ON y.division = p.division AND y.fighter = below)
SELECT division, above, below, CASE WHEN above_rank IS NULL OR below_rank IS NULL THEN 'unranked' ELSE 'reversed' END AS problem FROM t WHERE above_rank IS NULL OR below_rank IS NULL OR above_rank > below_rank""")
def required_order(spark, sf_dir):
    from .testdata import bouts

    pairs = bouts(spark, sf_dir).where("quantity = 50").select("division", F.col("a").alias("above"), F.col("b").alias("below")).distinct()
    return views.required_violations(wins_ranking(spark, sf_dir, "2001-06-01"), pairs).select("division", "above", "below", "problem")


@query(f"""{BOUTS_SQL}, e AS (SELECT division, winner, loser, max(date) AS date FROM (SELECT division, date, CASE WHEN score_a = 1 THEN a ELSE b END AS winner, CASE WHEN score_a = 1 THEN b ELSE a END AS loser FROM bouts WHERE score_a IN (0, 1)) GROUP BY ALL)
SELECT division, winner, loser FROM e WHERE date >= DATE '{AS_OF}' - 182 AND (winner, loser) NOT IN (SELECT (winner, loser) FROM e WHERE division = '1-URGENT')""")
def recent_expired_edges(spark, sf_dir):
    from .testdata import bouts

    b = bouts(spark, sf_dir).where("score_a in (0, 1)")
    won = F.col("score_a") == 1
    e = b.select("division", "date", F.when(won, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(won, F.col("b")).otherwise(F.col("a")).alias("loser")).groupBy("division", "winner", "loser").agg(F.max("date").alias("date"))
    return views.expired_edges(views.recent_violations(e, F.lit(AS_OF).cast("date")), e.where("division = '1-URGENT'")).select("division", "winner", "loser")

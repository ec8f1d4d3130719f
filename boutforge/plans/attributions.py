"""The change of a ranking by net wins between two days, taken apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import attribution
from .registry import query
from .sequences import _EDGES, edges
from .testdata import BOUTS_SQL, sides

SINCE, NOW = "2001-06-01", "2001-12-31"

_LATEST_SQL = "SELECT division, winner, loser FROM (SELECT *, row_number() OVER (PARTITION BY division, least(winner, loser), greatest(winner, loser) ORDER BY date DESC, bout_id) AS p FROM edges WHERE date <= DATE '{}') WHERE p = 1"


@query(f"""{BOUTS_SQL}, {_EDGES}, s AS (SELECT *, NOT (opener AND date < DATE '1998-01-01') AS counts, CASE result WHEN 'win' THEN 10 WHEN 'loss' THEN -10 ELSE 0 END AS delta FROM sides WHERE result <> 'nc' AND date <= DATE '{NOW}'),
p AS (SELECT division, fighter, CAST(1500 + sum(delta) AS DOUBLE) AS rating, count(*) AS fights FROM s WHERE date <= DATE '{SINCE}' GROUP BY ALL), c AS (SELECT division, fighter, CAST(1500 + sum(delta) AS DOUBLE) AS rating, count(*) AS fights FROM s WHERE counts GROUP BY ALL),
sp AS (SELECT *, rating - 70 / sqrt(CAST(greatest(fights, 2) AS DOUBLE)) AS shown FROM p), sc AS (SELECT *, rating - 70 / sqrt(CAST(greatest(fights, 2) AS DOUBLE)) AS shown FROM c),
rp AS (SELECT *, row_number() OVER (PARTITION BY division ORDER BY shown DESC, fighter) AS rank FROM sp), rc AS (SELECT *, row_number() OVER (PARTITION BY division ORDER BY shown DESC, fighter) AS rank FROM sc),
n AS (SELECT division, fighter, CAST(sum(delta) AS DOUBLE) AS moved, count(*) AS n FROM s WHERE date > DATE '{SINCE}' AND counts GROUP BY ALL),
e0 AS ({_LATEST_SQL.format(SINCE)}), e1 AS ({_LATEST_SQL.format(NOW)}), gone AS (SELECT * FROM e0 EXCEPT SELECT * FROM e1), made AS (SELECT * FROM e1 EXCEPT SELECT * FROM e0),
x AS (SELECT division, fighter, sum(g) AS expired, sum(m) AS resolved FROM (SELECT division, winner AS fighter, 1 AS g, 0 AS m FROM gone UNION ALL SELECT division, loser, 1, 0 FROM gone UNION ALL SELECT division, winner, 0, 1 FROM made UNION ALL SELECT division, loser, 0, 1 FROM made) GROUP BY ALL),
j AS (SELECT coalesce(rp.division, rc.division) AS division, coalesce(rp.fighter, rc.fighter) AS fighter, rp.rank AS b, rc.rank AS a, rc.shown - rp.shown AS change, rc.rating - rp.rating AS raw FROM rp FULL JOIN rc ON rp.division = rc.division AND rp.fighter = rc.fighter)
SELECT j.division, j.fighter, coalesce(b, 0) AS rank_before, coalesce(a, 0) AS rank_after, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'dropped' WHEN a < b THEN 'up' WHEN a > b THEN 'down' ELSE 'same' END AS move,
round(coalesce(change, 0), 6) AS change, CASE WHEN raw IS NULL THEN CAST(0 AS DOUBLE) ELSE coalesce(moved, 0) END AS bouts_part, coalesce(raw - coalesce(moved, 0), 0) AS ripple_part, round(coalesce(change - raw, 0), 6) AS discount_part, coalesce(n.n, 0) AS n_new, CAST(coalesce(expired, 0) AS BIGINT) AS expired, CAST(coalesce(resolved, 0) AS BIGINT) AS resolved
FROM j LEFT JOIN n ON n.division = j.division AND n.fighter = j.fighter LEFT JOIN x ON x.division = j.division AND x.fighter = j.fighter WHERE abs(coalesce(raw, 0)) >= 0.005 OR b IS NULL OR a IS NULL OR a <> b OR coalesce(expired, 0) > 0""")
def rank_attribution(spark, sf_dir):
    """A fighter counts once in each division; the current rules leave early openers out, which is the ripple."""
    delta = F.when(F.col("result") == "win", 10.0).when(F.col("result") == "loss", -10.0).otherwise(0.0)
    s = sides(spark, sf_dir).where(f"result <> 'nc' and date <= '{NOW}'")
    early, counted = F.col("date") <= SINCE, ~(F.col("opener") & (F.col("date") < "1998-01-01"))
    # both rankings and the bouts since from one pass over all sides
    rated = lambda rows, tag: [(1500 + F.sum(F.when(rows, delta))).alias(f"rating_{tag}"), F.count(F.when(rows, 1)).alias(f"fights_{tag}")]
    new = counted & ~early
    rows = s.groupBy("division", "fighter").agg(*rated(early, "before"), *rated(counted, "after"), F.sum(F.when(new, delta)).alias("moved"), F.count(F.when(new, 1)).alias("n_new"))
    shown = lambda tag: scores.sigma_discount(F.col(f"rating_{tag}"), F.col(f"fights_{tag}"))
    place = lambda tag: F.row_number().over(Window.partitionBy("division").orderBy(F.desc_nulls_last(shown(tag)), "fighter"))
    rows = rows.withColumns({f"rank_{tag}": F.when(F.col(f"rating_{tag}").isNotNull(), place(tag)) for tag in ("before", "after")})
    since, now = (F.lit(day).cast("date") for day in (SINCE, NOW))
    told = attribution.explained(rows, attribution.edge_changes_between(edges(spark, sf_dir), since, now, "bout_id"))
    numbers = {c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("change", *attribution.PARTS)} | {c: F.coalesce(c, F.lit(0)) for c in ("rank_before", "rank_after")}
    return told.withColumns(numbers)

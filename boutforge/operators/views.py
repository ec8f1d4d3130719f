"""What readers see: filtered lists, labelled ranks, notable points and comparisons with stated totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scores

SHOWN_RANKS = 15


def publishable(states: DataFrame, records: DataFrame, as_of: Column, *, per_period: float = 0.0) -> DataFrame:
    """states (fighter, rating, fights, last_date) of fighters that have a record, with the rating shown."""
    known = states.join(records.select("fighter").distinct(), "fighter", "left_semi")
    return known.withColumn("shown_rating", scores.decayed(F.col("rating"), F.datediff(as_of, F.col("last_date")), per_period))


def ranker_wins(sides: DataFrame, rankers: DataFrame, standing: DataFrame, year: int) -> DataFrame:
    """Fighters who in that year beat one who is ranked in their division and had standing (fighter, date) that day."""
    won = sides.where((F.col("result") == "win") & ~F.col("opener") & (F.year("date") == year)).select("fighter", "opponent", "date", "division")
    ranked = rankers.select("division", F.col("fighter").alias("opponent"))
    fit = standing.select(F.col("fighter").alias("opponent"), "date").distinct()
    return won.join(ranked, ["division", "opponent"], "left_semi").join(fit, ["opponent", "date"], "left_semi").select("fighter").distinct()


def with_champions(ranking: DataFrame, champions: DataFrame) -> DataFrame:
    """ranking (division, fighter, rank) without the divisions' champions, closed up, and the champions as rank 0."""
    c = champions.select("division", "fighter")
    rest = ranking.join(c, ["division", "fighter"], "left_anti")
    closed = rest.select("division", "fighter", F.row_number().over(Window.partitionBy("division").orderBy("rank")).alias("rank"), F.lit(False).alias("champion"))
    return closed.unionByName(c.select("division", "fighter", F.lit(0).alias("rank"), F.lit(True).alias("champion")))


def rank_labels(ranked: DataFrame, published: list[str]) -> DataFrame:
    """The rank as readers see it: champion, a number up to SHOWN_RANKS, else none; none at all in unpublished divisions but the champion."""
    shown = F.col("division").isin(published) & (F.col("rank") <= SHOWN_RANKS)
    return ranked.withColumn("label", F.when(F.col("champion"), "王者").when(shown, F.concat(F.col("rank").cast("string"), F.lit("位"))))


def moves(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """current (keys, rank) with move: new where the previous rank is missing or beyond the shown ones, up or down by places, or same."""
    p = previous.select(*keys, F.col("rank").alias("before"))
    diff = F.col("before") - F.col("rank")
    text = (
        F.when(F.col("before").isNull() | (F.col("before") > SHOWN_RANKS), "NEW")
        .when(diff > 0, F.concat(F.lit("▲"), diff.cast("string")))
        .when(diff < 0, F.concat(F.lit("▼"), (-diff).cast("string")))
        .otherwise("—")
    )
    return current.join(p, keys, "left").withColumn("move", text).drop("before")


def change_text(org: Column, group: Column, name: Column, kind: Column, before: Column, after: Column) -> Column:
    """A line about a change of ranking."""
    head = F.concat(F.lit("【"), org, F.lit(" "), group, F.lit("】"), name)
    place = lambda c: c.cast("string")
    between = F.concat(place(before), F.lit("位→"), place(after), F.lit("位に"))
    return (
        F.when(kind == "champion", F.concat(F.lit("【"), org, F.lit(" "), group, F.lit("】新王者"), name, F.lit("が誕生。")))
        .when(kind == "vacated", F.concat(F.lit("【"), org, F.lit(" "), group, F.lit("】王座が空位に(前王者:"), name, F.lit(")。")))
        .when(kind == "up", F.concat(head, F.lit("が"), between, F.lit("上昇。")))
        .when(kind == "down", F.concat(head, F.lit("が"), between, F.lit("後退。")))
        .when(kind == "new", F.concat(head, F.lit("がランクイン("), place(after), F.lit("位)。")))
        .when(kind == "dropped", F.concat(head, F.lit("がランク外に(前回"), place(before), F.lit("位)。")))
    )


def rating_deltas(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """current (keys, rating, version) with delta, null where there was no rating or another version of the rules made it."""
    p = previous.select(*keys, F.col("rating").alias("__was"), F.col("version").alias("__v"))
    known = F.col("__was").isNotNull() & (F.col("version") == F.col("__v"))
    return current.join(p, keys, "left").withColumn("delta", F.when(known, scores.half_up(F.col("rating") - F.col("__was")))).drop("__was", "__v")


def attribution(trace: DataFrame, since: Column) -> DataFrame:
    """Each fighter's bouts after a date with what they moved: opponent, date, result and delta to two places."""
    result = F.when(F.col("score") == 0.5, "draw").when(F.col("score") == 1, "win").otherwise("loss")
    return trace.where(F.col("date") > since).select("fighter", "opponent", "date", result.alias("result"), scores.half_up(F.col("after") - F.col("before"), 2).alias("delta"))


def expired_edges(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Resolved pairs (winner, loser) of the previous snapshot that the current one has no more."""
    return previous.join(current.select("winner", "loser"), ["winner", "loser"], "left_anti")


def comparable(pairs: DataFrame, fighters: DataFrame, bouts: DataFrame) -> DataFrame:
    """pairs (a, b) that have something in common: promotion and class, a bout, or an opponent."""
    f = lambda side: fighters.select(F.col("fighter").alias(side), F.struct("org", "division").alias(f"__{side}"))
    both = pairs.join(f("a"), "a", "left").join(f("b"), "b", "left")
    met = bouts.select(F.col("fighter").alias("a"), F.col("opponent").alias("b")).distinct().withColumn("met", F.lit(True))
    against = bouts.select("fighter", "opponent").distinct()
    third = pairs.join(against.select(F.col("fighter").alias("a"), "opponent"), "a").join(against.select(F.col("fighter").alias("b"), "opponent"), ["b", "opponent"], "left_semi").select("a", "b").distinct().withColumn("shared", F.lit(True))
    told = both.join(met, ["a", "b"], "left").join(third, ["a", "b"], "left")
    return told.where(F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)) | F.col("met") | F.col("shared")).select("a", "b")


def visible(fighters: DataFrame, records: DataFrame, rolled: DataFrame) -> DataFrame:
    """Fighters neither hidden nor delisted that have a record of their own or a rolled-up one."""
    open_ = fighters.where("not hidden and not delisted")
    has = records.where("wins + losses + draws > 0").select("fighter").unionByName(rolled.where("wins + losses + draws > 0").select("fighter")).distinct()
    return open_.join(has, "fighter", "left_semi")


def searched(fighters: DataFrame, *, weight_class: str | None = None, tag: str | None = None, text: str = "") -> DataFrame:
    """fighters (weight_class, tags, name, name_en) of a class and tag whose name holds the text in either kana or the English one in any case."""
    found = fighters
    if weight_class is not None:
        found = found.where(F.col("weight_class") == weight_class)
    if tag is not None:
        found = found.where(F.array_contains("tags", tag))
    if text.strip():
        q = F.lit(text.strip())
        plain = names.squeezed(q)
        name = names.squeezed(F.col("name"))
        found = found.where(name.contains(plain) | name.contains(names.to_katakana(plain)) | name.contains(names.to_hiragana(plain)) | F.lower("name_en").contains(F.lower(q)))
    return found


def looked_up(entries: DataFrame, text: str, columns: list[str], *, org: str | None = None, page: int = 1, size: int = 30, order: str = "name") -> DataFrame:
    """Entries of which any column holds the text, white space, case and kana aside; pages add up, so the first n pages are shown."""
    plain = lambda c: F.lower(names.to_katakana(names.nfkc(F.regexp_replace(c, "[\\s　]", ""))))
    found = entries if org is None else entries.where(F.array_contains("orgs", org))
    if text.strip():
        q = plain(F.lit(text))
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(plain(F.col(c)).contains(q), F.lit(False))
        found = found.where(hit)
    return found.orderBy(order).limit(max(1, page) * size)


def years_of(events: DataFrame, date: str) -> DataFrame:
    """The distinct years, latest first."""
    return events.select(F.year(date).alias("year")).distinct().orderBy(F.desc("year"))


def without_ratings(view: DataFrame) -> DataFrame:
    """The view as it leaves the house: ranks and records, but no ratings."""
    return view.drop("rating", "raw_rating")


def candidates(rankings: DataFrame, published: list[str], champions: DataFrame, defences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Challengers of published divisions; champions with their defences, null and known as an issue where they aren't recorded."""
    challengers = rankings.where(F.col("division").isin(published)).select("fighter", "division", F.col("rank").alias("division_rank"), "rating")
    return challengers, champions.join(defences.select("fighter", "defences"), "fighter", "left").withColumn("issue", F.col("defences").isNull())


def bout_rows(bouts: DataFrame) -> DataFrame:
    """bouts (date, result_type, is_win) as rows of a record: dated, decided, drawn or without contest."""
    result = F.when(F.col("result_type") == "decisive", F.when(F.col("is_win"), "win").otherwise("loss")).when(F.col("result_type").isin("draw", "nc"), F.col("result_type"))
    return bouts.withColumn("result", result).where("date is not null and result is not null").drop("result_type", "is_win")


def finished_classes(entries: DataFrame, lookup: DataFrame) -> DataFrame:
    """Official rankings (class, rank, name) with slugs, in rank order; nameless entries and so empty classes go."""
    from ..functions.classify import rank_order

    known = lookup.select(F.col("name").alias("__n"), "slug")
    kept = entries.where("name is not null and name <> ''").join(known, names.bare(F.col("name")) == F.col("__n"), "left").drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(rank_order(F.col("rank")), "name")))


def class_counts(entries: DataFrame) -> DataFrame:
    """How many classes are ranked, and how many have no vacant title."""
    vacant = F.max((F.col("rank") == "空位") | (F.col("name") == "空位"))
    per = entries.groupBy("class").agg(vacant.alias("vacant"))
    return per.agg(F.count("*").alias("ranked"), F.count(F.when(~F.col("vacant"), 1)).alias("with_champion"))


def notable(pairs: DataFrame) -> DataFrame:
    """Points worth a line about two fighters from their rates (name, finish, decision and sub percentages, suffixed _a and _b).

    High rates are 70, 50 and 60 percent; finish rates 30 points apart are named too.
    """
    points = []
    for side in ("a", "b"):
        col = lambda c, s=side: F.col(f"{c}_{s}")
        points += [
            F.when(col("finish") >= 70, F.concat(col("name"), F.lit("のフィニッシュ率は"), col("finish").cast("string"), F.lit("%と非常に高い"))),
            F.when(col("decision") >= 50, F.concat(col("name"), F.lit("は判定決着が"), col("decision").cast("string"), F.lit("%を占める"))),
            F.when(col("sub") >= 60, F.concat(col("name"), F.lit("は一本勝ちの比率が"), col("sub").cast("string"), F.lit("%を占め、サブミッション色が強い"))),
        ]
    gap = F.abs(F.col("finish_a") - F.col("finish_b"))
    pair = F.concat(F.lit("両者のフィニッシュ率には"), gap.cast("string"), F.lit("ポイントの差がある("), F.col("name_a"), F.col("finish_a").cast("string"), F.lit("% / "), F.col("name_b"), F.col("finish_b").cast("string"), F.lit("%)"))
    return pairs.withColumn("points", F.array_compact(F.array(*points, F.when(gap >= 30, pair))))


def kick_records(bouts: DataFrame) -> DataFrame:
    """Records that count neither walkovers nor what was planned, cancelled or without contest; unknown results apart."""
    held = bouts.where("coalesce(method, '') <> 'walkover' and result not in ('scheduled', 'no_contest', 'cancelled')")
    n = lambda r: F.count(F.when(F.col("result") == r, 1))
    out = held.groupBy("fighter").agg(n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"), n("unknown").alias("unknown"))
    return out.withColumn("total", F.col("wins") + F.col("losses") + F.col("draws") + F.col("unknown"))


def against_stated(derived: DataFrame, stated: DataFrame, *, tolerance: int = 0) -> DataFrame:
    """stated (key, stated_total) beside derived (key, total): full, smaller within or beyond tolerance, larger, missing."""
    both = stated.join(derived.select("key", "total"), "key", "left")
    short = F.col("stated_total") - F.col("total")
    return both.withColumn("status", F.when(F.col("total").isNull(), "missing").when(short == 0, "full").when(short < 0, "larger").when(short <= tolerance, "within").otherwise("smaller"))


def coverage(sample: DataFrame, captured: DataFrame, out_of_scope: Column, listed: DataFrame) -> DataFrame:
    """Counts of a sample (group, key): captured, out of scope, A (the fighter isn't listed) and C (listed, but not this)."""
    c = captured.select("key").distinct().withColumn("captured", F.lit(True))
    known = listed.select("fighter").distinct().withColumn("listed", F.lit(True))
    kind = F.when(F.col("captured"), "captured").when(out_of_scope, "out_of_scope").when(F.col("listed").isNull(), "A").otherwise("C")
    told = sample.join(c, "key", "left").join(known, "fighter", "left").withColumn("kind", kind)
    return told.groupBy("group").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k.lower()) for k in ("captured", "out_of_scope", "A", "C")))


def coverage_gaps(held: DataFrame, covered: DataFrame, keys: list[str], today: Column, *, window: int, grace: int, known: DataFrame | None = None) -> DataFrame:
    """Events (keys, date) from window to grace days ago that aren't covered; expected says that the baseline knows."""
    due = held.where((F.col("date") >= F.date_sub(today, window)) & (F.col("date") < F.date_sub(today, grace)))
    open_ = due.join(covered.select(*keys).distinct(), keys, "left_anti")
    if known is None:
        return open_.withColumn("expected", F.lit(False))
    base = known.select(*keys).distinct().withColumn("__known", F.lit(True))
    return open_.join(base, keys, "left").withColumn("expected", F.coalesce("__known", F.lit(False))).drop("__known")


def required_violations(ranking: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (division, above, below) that have to stand so and don't: reversed, or one of them isn't ranked."""
    r = lambda name: ranking.select("division", F.col("fighter").alias(name), F.col("rank").alias(f"{name}_rank"))
    told = pairs.join(r("above"), ["division", "above"], "left").join(r("below"), ["division", "below"], "left")
    missing = F.col("above_rank").isNull() | F.col("below_rank").isNull()
    return told.withColumn("problem", F.when(missing, "unranked").when(F.col("above_rank") > F.col("below_rank"), "reversed")).where("problem is not null")


def recent_violations(violations: DataFrame, as_of: Column, days: int = 182) -> DataFrame:
    """Violations by bouts of the last half year."""
    return violations.where(F.col("date") >= F.date_sub(as_of, days))

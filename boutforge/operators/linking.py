"""Rows brought together by names, dates and events where a plain equi-join doesn't do.

Every join has an equal key (a name, a date, a day shifted by a few, a pair); what is fuzzy is a condition
on rows that already share it. Lookup tables join by Spark's own choice of strategy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .resolve import greedy_pairs, sole_match, within_days


def name_forms(name: Column) -> Column:
    """The ways in which a name may be written: as it is, without a nickname, and both in either kana."""
    plain = [names.squeezed(name), names.squeezed(names.nameless_quotes(name))]
    return F.array_distinct(F.filter(F.array(*(form for p in plain for form in (p, names.to_katakana(p), names.to_hiragana(p)))), lambda x: x != ""))


def by_any_name(rows: DataFrame, key: str, name: str, roster: DataFrame) -> DataFrame:
    """rows (key, name) with slug, from roster (slug, name, aliases, hidden, ord).

    A main name counts before an alias, an earlier fighter before a later one; a name that several
    fighters claim resolves to none; hidden fighters are never linked.
    """
    main = roster.select("slug", "ord", "hidden", names.squeezed(F.col("name")).alias("form"), F.lit(0).alias("pass"))
    other = roster.select("slug", "ord", "hidden", F.explode("aliases").alias("alias")).select("slug", "ord", "hidden", names.squeezed(F.col("alias")).alias("form"), F.lit(1).alias("pass"))
    claims = main.unionByName(other)
    sole = claims.groupBy("form").agg(F.min("slug").alias("lo"), F.max("slug").alias("hi")).where("lo = hi").select("form")
    known = claims.where("not hidden").join(sole, "form", "left_semi")
    wanted = rows.select(key, F.explode(name_forms(F.col(name))).alias("form"))
    best = wanted.join(known, "form").groupBy(key).agg(F.min_by("slug", F.struct("pass", "ord")).alias("slug"))
    return rows.join(best, key, "left")


def without_suppressed(rows: DataFrame, denied: DataFrame) -> DataFrame:
    """rows (fighter, date, opponent) without the links that denied forbids; names compare without case."""
    lower = denied.select("fighter", "date", F.lower("opponent").alias("__low"))
    return rows.withColumn("__low", F.lower("opponent")).join(lower, ["fighter", "date", "__low"], "left_anti").drop("__low")


def overridden_pairs(rows: DataFrame, overrides: DataFrame, keys: list[str], a: str, b: str, value: str) -> DataFrame:
    """rows whose keys and unordered pair (a, b) are in overrides take its value."""
    pair = lambda x, y: names.pair_key(F.col(x), F.col(y)).alias("__pair")
    new = overrides.select(*keys, pair(a, b), F.col(value).alias("__new"))
    return rows.withColumn("__pair", pair(a, b)).join(new, [*keys, "__pair"], "left").withColumn(value, F.coalesce("__new", value)).drop("__pair", "__new")


def grouped_in_order(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """One row for each key, in order of first appearance, with its values in order; ``first`` is that place."""
    kept = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.transform(kept, lambda x: x["v"]).alias("values"))


def by_source_or_identity(bouts: DataFrame, roster: DataFrame) -> DataFrame:
    """bouts (match_by, source_url, identity) with owner, from roster (identity, sources); unmatched ones have none."""
    known = roster.select(F.col("identity").alias("owner"))
    urls = roster.select(F.col("identity").alias("owner"), F.explode("sources").alias("source_url")).groupBy("source_url").agg(F.max("owner").alias("owner"))
    own = bouts.where("match_by = 'identity'").join(known, F.col("identity") == F.col("owner"), "left")
    page = bouts.where("match_by <> 'identity'").join(urls, "source_url", "left")
    return own.unionByName(page)


def gym_compatible(a: Column, b: Column) -> Column:
    """Whether two gyms, each named and not free, are equal or one's name holds the other's."""
    plain = lambda g: F.regexp_replace(F.regexp_replace(F.lower(g), "ジム|gym|キックボクシング|kickboxing|道場|会館|塾|team|チーム|ボクシング|[“”\"'’‘`]", ""), "[\\s　／/・\\-,、。.]", "")
    x, y = plain(F.coalesce(a, F.lit(""))), plain(F.coalesce(b, F.lit("")))
    named = lambda g: ~F.coalesce(g, F.lit("フリー")).isin("フリー", "無所属", "free")
    return (x != "") & (y != "") & named(a) & named(b) & (x.contains(y) | y.contains(x))


def opponents(bouts: DataFrame, roster: DataFrame) -> DataFrame:
    """bouts (bout_id, site_slug, opponent, gym) with resolved, ambiguous and candidates.

    roster: identity, site_slug, name, gym. A site's own link counts first, then a name that one fighter
    has, then among homonyms the only one of a compatible gym; else the candidates are listed, and n_candidates
    is their number. What a bout finds depends on its name and gym alone, so the distinct ones of bouts meet the
    distinct ones of the roster with their counts, and a name's candidates are collected once.
    """
    linked = roster.where("site_slug is not null").select("site_slug", F.col("identity").alias("__linked"))
    placed = bouts.withColumn("__name", names.squeezed(F.col("opponent"))).join(linked, "site_slug", "left")
    people = roster.select(names.squeezed(F.col("name")).alias("__name"), F.col("identity").alias("__id"), F.col("gym").alias("__theirs")).where("__name is not null")
    alike = people.groupBy("__name", "__theirs").agg(F.count("*").alias("__n"), F.min("__id").alias("__id"))
    asked = bouts.select(names.squeezed(F.col("opponent")).alias("__name"), F.col("gym").alias("__own")).distinct()
    fits = gym_compatible(F.col("__own"), F.col("__theirs"))
    found = asked.join(alike, "__name").groupBy("__name", "__own").agg(F.sum("__n").alias("__n"), F.min("__id").alias("__first"), F.coalesce(F.sum(F.when(fits, F.col("__n"))), F.lit(0)).alias("__fit"), F.min(F.when(fits, F.col("__id"))).alias("__fitting"))
    found = found.withColumnRenamed("__name", "__asked")
    every = people.groupBy("__name").agg(F.sort_array(F.collect_list("__id")).alias("__all"))
    open_ = F.col("__linked").isNull()
    by_name = F.when(F.col("__n") == 1, F.col("__first")).when(F.col("__fit") == 1, F.col("__fitting"))
    several = open_ & (F.col("__n") > 1) & (F.col("__fit") != 1)
    both = placed.join(found, (F.col("__name") == F.col("__asked")) & F.col("gym").eqNullSafe(F.col("__own")), "left").join(every, "__name", "left")
    return both.select(
        *bouts.columns,
        F.coalesce("__linked", by_name).alias("resolved"),
        F.coalesce(several, F.lit(False)).alias("ambiguous"),
        F.when(several, F.col("__all")).alias("candidates"),
        F.when(F.coalesce(several, F.lit(False)), F.col("__n")).otherwise(0).alias("n_candidates"),
    )


def event_links(rows: DataFrame, events: DataFrame, *, days: int = 1, gram: int = 3) -> DataFrame:
    """rows (key, event, date) with the slug of the one event (slug, name, date) that fits, else null.

    Equal names go before names that the text holds with no further digit next to them, and the date
    may be some days off. Rows and events meet on the days a date may mean.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "[\\s　・]", ""))
    r = rows.select("key", plain(F.col("event")).alias("target"), F.explode(F.array(*(F.date_add("date", d) for d in range(-days, days + 1)))).alias("date"))
    e = events.select("slug", plain(F.col("name")).alias("name"), "date").where(F.length("name") >= gram)
    at = F.instr(F.col("target"), F.col("name"))
    before, behind = F.substring(F.col("target"), at - 1, 1), F.substr(F.col("target"), at + F.char_length("name"), F.lit(1))
    digit = lambda c: c.rlike("^[0-9]$")
    head, tail = digit(F.substring("name", 1, 1)) & digit(before) & (at > 1), digit(F.right("name", F.lit(1))) & digit(behind)
    met = r.join(e, "date").withColumn("exact", F.col("target") == F.col("name")).where(F.col("exact") | ((at > 0) & ~head & ~tail))
    best = met.withColumn("any_exact", F.max("exact").over(Window.partitionBy("key"))).where("exact or not any_exact").select("key", "slug").distinct()
    return rows.join(sole_match(best, "key"), "key", "left")


def two_pass_pairs(official: DataFrame, local: DataFrame, passes: list[str]) -> DataFrame:
    """(id, other) pairs, one to one: by the first key, then by the next among what is left; null keys pair with nothing."""
    pairs = None
    for column in passes:
        a, b = official.where(F.col(column).isNotNull()), local.where(F.col(column).isNotNull())
        if pairs is not None:
            a, b = a.join(pairs.select("id"), "id", "left_anti"), b.join(pairs.select("other"), "other", "left_anti")
        found = greedy_pairs(a.select("id", column), b.select("other", column), [column], "id", "other").select("id", "other")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def card_changes(local: DataFrame, official: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Bouts (keys, a, b) that only one side has: added, removed, or changed where exactly one name is shared.

    A change joins a removed bout with the first added one that shares a name; an added one goes to the first that takes
    it. Rows are dealt by their keys once, to so many tasks, and all steps stay within a card.
    """
    side = lambda rows, mine: rows.select(*keys, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.lit(mine).alias("mine"))
    dealt = side(local, True).unionByName(side(official, False)).repartition(*([] if tasks is None else [tasks]), *keys)
    one_sided = dealt.groupBy(*keys, "lo", "hi").agg(F.min("mine").alias("mine"), F.max("mine").alias("any")).where("mine = any")
    named = one_sided.select(*keys, "mine", names.pair_key(F.col("lo"), F.col("hi")).alias("pair"), F.explode(F.array("lo", "hi")).alias("name"))
    first_new = F.min(F.when(~F.col("mine") & F.col("name").isNotNull(), F.col("pair"))).over(Window.partitionBy(*keys, "name"))
    # a removed bout with its first partner, an added one with itself
    wanted = named.withColumn("new", F.when(F.col("mine"), first_new).otherwise(F.col("pair"))).groupBy(*keys, "mine", "pair").agg(F.min("new").alias("new"))
    first_old = F.min(F.when(F.col("mine"), F.col("pair"))).over(Window.partitionBy(*keys, "new"))
    told = wanted.withColumn("first_old", F.when(F.col("new").isNotNull(), first_old)).where("mine or first_old is null")
    taken = F.coalesce(F.col("pair") == F.col("first_old"), F.lit(False))
    return told.select(
        *keys,
        F.when(F.col("mine"), F.col("pair")).alias("old"),
        F.when(~F.col("mine") | taken, F.col("new")).alias("new"),
        F.when(~F.col("mine"), "added").when(taken, "changed").otherwise("removed").alias("change"),
    )


def order_changed(local: DataFrame, official: DataFrame, keys: list[str]) -> DataFrame:
    """keys whose cards hold the same pairs in another sequence; cards have a, b and place."""
    pair = names.pair_key(F.col("a"), F.col("b"))
    card = lambda rows, side: rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", pair.alias("pair")))), lambda x: x["pair"]).alias(side))
    both = card(local, "mine").join(card(official, "theirs"), keys)
    return both.where((F.array_sort("mine") == F.array_sort("theirs")) & (F.col("mine") != F.col("theirs"))).select(*keys)


def new_against(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, date, opponent) that known hasn't, in three steps.

    Known are rows of the same date and opponent; undated rows of a known opponent; and where either side
    has one row alone on a date, that row whatever the opponent is called.
    """
    dated = known.where("date is not null").select(*keys, "date", "opponent").distinct()
    left = rows.join(dated, [*keys, "date", "opponent"], "left_anti")
    undated = left.where("date is null").join(known.select(*keys, "opponent").distinct(), [*keys, "opponent"], "left_anti")
    alone = lambda frame: frame.where("date is not null").groupBy(*keys, "date").agg(F.count("*").alias("n")).where("n = 1").select(*keys, "date")
    one_each = alone(rows).join(alone(known), [*keys, "date"], "left_semi")
    return left.where("date is not null").join(one_each, [*keys, "date"], "left_anti").unionByName(undated.select(*left.columns))


def first_seen(rows: DataFrame, archive: DataFrame) -> DataFrame:
    """rows (url, first_seen) with the archive's first stamp (url, first_seen, ord) where they have none."""
    known = archive.where("first_seen is not null").groupBy("url").agg(F.min_by("first_seen", "ord").alias("__seen"))
    return rows.join(known, "url", "left").withColumn("first_seen", F.coalesce("first_seen", "__seen")).drop("__seen")


def ranked_names(ranking: DataFrame, roster: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """ranking (by, slug, rank) with names from roster (slug, name); the unknown drop out and ranks close up."""
    named = ranking.join(roster, "slug").withColumn("shown_rank", F.row_number().over(Window.partitionBy(by).orderBy("rank")))
    return named if top is None else named.where(F.col("shown_rank") <= top)


def shares_opponent(a: DataFrame, b: DataFrame) -> DataFrame:
    """The keys whose histories (key, opponent) on both sides have an opponent in common."""
    plain = lambda rows: rows.select("key", names.squeezed(F.col("opponent")).alias("opponent"))
    return plain(a).join(plain(b), ["key", "opponent"], "left_semi").select("key").distinct()


def preferred_record(fighters: DataFrame, sources: list[tuple[str, DataFrame]], guard: DataFrame | None = None) -> DataFrame:
    """Each fighter's record from the first source that has one; wins, losses, draws and the source's name.

    With a guard (key, opponent) a source counts only for fighters whose history in it shares an opponent.
    """
    out = fighters.select("key")
    for name, rows in sources:
        good = rows.where("wins + losses + draws > 0")
        if guard is not None and "opponents" in rows.columns:
            good = good.join(shares_opponent(good.select("key", F.explode("opponents").alias("opponent")), guard), "key", "left_semi")
        out = out.join(good.select("key", F.struct("wins", "losses", "draws", F.lit(name).alias("source")).alias(f"__{name}")), "key", "left")
    best = F.coalesce(*(F.col(f"__{name}") for name, _ in sources))
    record = out.select("key", best.alias("r"))
    return record.select("key", *(F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("wins", "losses", "draws")), F.col("r.source").alias("source"), F.col("r").isNull().alias("no_record"))


def history_of(events: DataFrame, key: str = "name") -> DataFrame:
    """Both sides' histories from event results (date, a, b, winner, method); what wasn't fought drops out."""
    view = lambda own, other: F.struct(F.col(own).alias(key), F.col(other).alias("opponent"), F.when(F.col("winner") == "NC", "nc").when(F.col("winner") == "引き分け", "draw").when(F.col("winner") == F.col(own), "win").otherwise("loss").alias("result"))
    held = events.where("winner is not null and winner <> '中止'")
    return held.select("date", "method", F.explode(F.array(view("a", "b"), view("b", "a"))).alias("s")).select("s.*", "date", "method")


def known_names(roster: DataFrame) -> DataFrame:
    """slug and the distinct normal forms of its name and aliases."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return roster.select("slug", F.explode(every).alias("n")).groupBy("slug").agg(F.sort_array(F.collect_set(names.squeezed(F.col("n")))).alias("forms"))


def confirmed_by_opponent(candidates: DataFrame, bouts: DataFrame) -> DataFrame:
    """candidates (key, slug, date, name) for which slug has a bout (slug, date, opponent) that day against that name, in part at least."""
    plain = lambda c: F.lower(names.squeezed(c))
    met = candidates.join(bouts.select("slug", "date", F.col("opponent").alias("__o")), ["slug", "date"])
    x, y = plain(F.col("name")), plain(F.col("__o"))
    return met.where((y != "") & (x.contains(y) | y.contains(x))).select("key").distinct()


def removed_kinds(previous: DataFrame, fresh: DataFrame, roster: DataFrame, *, days: int = 5) -> DataFrame:
    """Rows of previous (fighter, date, opponent) that fresh lacks, and why: off_roster, moved (the same opponent within days) or open."""
    gone = previous.join(fresh.select("fighter", "date", "opponent"), ["fighter", "date", "opponent"], "left_anti")
    listed = roster.select("fighter", F.lit(True).alias("listed")).distinct()
    near = within_days(gone.select("fighter", "opponent", "date"), fresh.select("fighter", "opponent", F.col("date").alias("other")), ["fighter", "opponent"], days, "date", "other").select("fighter", "opponent", "date").distinct().withColumn("near", F.lit(True))
    told = gone.join(listed, "fighter", "left").join(near, ["fighter", "opponent", "date"], "left")
    return told.withColumn("kind", F.when(F.col("listed").isNull(), "off_roster").when(F.col("near"), "moved").otherwise("open")).drop("listed", "near")


def suspects(previous: DataFrame, fresh: DataFrame, keys: list[str], text: Column, words: list[str]) -> DataFrame:
    """New rows whose text has one of the words, with the first listed that it has."""
    delta = fresh.join(previous.select(*keys).distinct(), keys, "left_anti")
    hit = F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))
    return delta.withColumn("suspect", hit).where("suspect is not null")


def alternates(titles: DataFrame, people: DataFrame) -> DataFrame:
    """people (key, name, aliases) with the title that exists for them and how it was found: as named, without spaces, or by an alias."""
    forms = people.select("key", F.posexplode(F.concat(F.array(F.struct(F.lit("name").alias("how"), F.col("name").alias("title"))), F.array(F.struct(F.lit("squeezed").alias("how"), names.squeezed(F.col("name")).alias("title"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("alias").alias("how"), a.alias("title"))))).alias("n", "f")).select("key", "n", "f.*")
    return forms.join(titles.select("title").distinct(), "title", "left_semi").groupBy("key").agg(F.min_by(F.struct("title", "how"), "n").alias("f")).select("key", "f.*")


def flattened(sources: list[DataFrame], columns: list[str]) -> DataFrame:
    """Rows of several sources under the columns they share; what a source lacks is null, rows without an event go."""
    shaped = [s.select(*((F.col(c) if c in s.columns else F.lit(None)).cast("string").alias(c) for c in columns)) for s in sources]
    return reduce(DataFrame.unionByName, shaped).where(F.trim("event") != "")



def fuzzy(rows: DataFrame, key: str, name: str, roster: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """rows with slug from roster (slug, name, aliases): a verified one (key, slug), else by alias, by the name without
    a quoted nickname, by the plain name, or by a roster name without its own nickname; ambiguous forms resolve to none."""
    plain, bare = names.kick_key(F.col("name")), names.kick_key(names.nameless_quotes(F.col("name")))
    tables = [
        roster.select(F.explode("aliases").alias("n"), "slug").select(names.kick_key(F.col("n")).alias("k"), "slug"),
        roster.select(plain.alias("k"), "slug"),
        roster.select(plain.alias("k"), "slug"),
        roster.where(plain != bare).select(bare.alias("k"), "slug"),
    ]
    own, stripped = names.kick_key(F.col(name)), names.kick_key(names.nameless_quotes(F.col(name)))
    wanted = rows.select(key, own.alias("__0"), F.when(own != stripped, stripped).alias("__1"), own.alias("__2"), own.alias("__3"))
    found = []
    for n, table in enumerate(tables):
        sole = table.groupBy("k").agg(F.min("slug").alias("lo"), F.max("slug").alias("hi")).where("lo = hi").select(F.col("k").alias(f"__{n}"), F.col("lo").alias(f"slug_{n}"))
        wanted = wanted.join(sole, f"__{n}", "left")
        found.append(F.col(f"slug_{n}"))
    if verified is not None:
        wanted = wanted.join(verified.select(key, F.col("slug").alias("slug_v")), key, "left")
        found.insert(0, F.col("slug_v"))
    return rows.join(wanted.select(key, F.coalesce(*found).alias("slug")), key)


def by_alias(rows: DataFrame, column: str, aliases: dict[str, str], dimension: DataFrame, name: str) -> DataFrame:
    """rows with the dimension row whose name is the column's, written otherwise for the aliases."""
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    usual = F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)) if pairs else F.col(column)
    return rows.withColumn("__usual", usual).join(dimension, F.col("__usual") == F.col(name), "left").drop("__usual")

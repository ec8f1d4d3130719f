"""Hand-kept corrections, applied to tables of any size.

Registries are written by hand, so the few rows of one fighter or event are brought to its rows; which
side is broadcast is left to Spark's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, names
from .linking import overridden_pairs

FIELDS = ["date", "opponent", "result", "method", "event", "round", "weight_class"]
PATCH = ["ord", "type", *FIELDS, "new_date"]


def _folded(row: Column, patches: Column) -> Column:
    """The row (FIELDS, alive) after the patches in order; each sees what the ones before it made."""
    field = lambda a, n: a[n].alias(n)

    def step(a: Column, p: Column) -> Column:
        hit = a["alive"] & (a["date"] == p["date"]) & (a["opponent"] == p["opponent"])
        kind = p["type"]
        to = lambda n, when, value: F.when(hit & when, value).otherwise(a[n]).alias(n)
        result, both = kind == "patch-result", kind.isin("patch-result", "patch-method")
        return F.struct(
            to("date", kind == "patch-date", p["new_date"]),
            field(a, "opponent"),
            to("result", result, p["result"]),
            to("method", both, p["method"]),
            to("event", kind == "patch-method", F.coalesce(p["event"], a["event"])),
            to("round", both, F.coalesce(p["round"], a["round"])),
            to("weight_class", kind == "patch-weight-class", p["weight_class"]),
            F.when(hit & (kind == "remove"), False).otherwise(a["alive"]).alias("alive"),
        )

    return F.aggregate(patches, row, step)


def patched(history: DataFrame, patches: DataFrame) -> DataFrame:
    """history (fighter and FIELDS, all text) after patches (fighter, ord, type, FIELDS, new_date).

    Patches of one fighter apply in order: remove, patch-date, patch-result, patch-method, patch-weight-class,
    and add, which adds a row unless there is one of that date and opponent by then.
    """
    by_fighter = patches.where("type <> 'add'").groupBy("fighter").agg(F.array_sort(F.collect_list(F.struct(*PATCH))).alias("__p"))
    none = F.array().cast(by_fighter.schema["__p"].dataType)
    row = F.struct(*(F.col(c).cast("string").alias(c) for c in FIELDS), F.lit(True).alias("alive"))
    old = history.join(by_fighter, "fighter", "left").withColumn("__p", F.coalesce("__p", none))
    adds = patches.where("type = 'add'").select("fighter", F.col("ord").alias("__at"), *FIELDS)
    added = adds.join(by_fighter, "fighter", "left").withColumn("__p", F.coalesce("__p", none))
    # what history and earlier additions have become by the time of an addition decides whether it is needed; an
    # earlier one that wasn't needed has a row of its key beside it that fares alike
    rows_so_far = old.select("fighter", row.alias("__r"), "__p", F.lit(-1).alias("__from")).unionByName(added.select("fighter", row.alias("__r"), "__p", F.col("__at").alias("__from")))
    told = rows_so_far.join(adds.select("fighter", "__at", F.col("date").alias("__d"), F.col("opponent").alias("__o")), "fighter").where("__from < __at")
    then = told.withColumn("__r", _folded(F.col("__r"), F.filter("__p", lambda p: (p["ord"] > F.col("__from")) & (p["ord"] < F.col("__at")))))
    there = then.where(F.col("__r.alive") & (F.col("__r.date") == F.col("__d")) & (F.col("__r.opponent") == F.col("__o"))).select("fighter", "__at")
    new = added.join(there, ["fighter", "__at"], "left_anti")
    later = F.filter("__p", lambda p: p["ord"] > F.col("__at"))
    rows = old.select("fighter", _folded(row, F.col("__p")).alias("r")).unionByName(new.select("fighter", _folded(row, later).alias("r")))
    return rows.where("r.alive").select("fighter", *(F.col(f"r.{c}").alias(c) for c in FIELDS))


def ruled(sides: DataFrame, rulings: DataFrame, keys: list[str]) -> DataFrame:
    """sides with the result after rulings (keys, missed_by) on missed weight."""
    told = sides.join(rulings.select(*keys, F.col("missed_by").alias("__by")), keys, "left")
    return told.withColumn("result", classify.result_after_ruling(F.col("result"), F.col("__by"))).drop("__by")


def flagged(rows: DataFrame, listed: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """rows whose flag holds where the source says so or the list has them."""
    hit = rows.join(listed.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
    return hit.withColumn(flag, F.coalesce(flag, F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def overlaid(rows: DataFrame, overlay: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows whose column is what the overlay has for their keys, else their own."""
    new = overlay.select(*keys, F.col(column).alias("__new"))
    return rows.join(new, keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def scoped_fights(sides: DataFrame, current: DataFrame, overrides: DataFrame) -> DataFrame:
    """Bouts of each fighter that lie in its current division, with overrides (fighter, date, division) of single bouts."""
    placed = overlaid(sides.select("fighter", "date", "division"), overrides, ["fighter", "date"], "division")
    return placed.join(current.select("fighter", F.col("division").alias("__now")), "fighter").groupBy("fighter").agg(F.count(F.when(F.col("division") == F.col("__now"), 1)).alias("fights"))


def excluded(rows: DataFrame, registries: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """rows that none of the registries lists under its keys."""
    for listed, keys in registries:
        rows = rows.join(listed.select(*keys).distinct(), keys, "left_anti")
    return rows


def supplemented(bouts: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """bouts (keys, a, b, place) and the pairs of extra that they lack, numbered anew from the end of each card.

    Extra bouts of events that aren't there fit nowhere: see ``homeless``.
    """
    pair = names.pair_key(names.squeezed(F.col("a")), names.squeezed(F.col("b")))
    have = bouts.withColumn("__pair", pair)
    held = extra.join(bouts.select(*keys).distinct(), keys, "left_semi")
    new = held.withColumn("__pair", pair).join(have.select(*keys, "__pair"), [*keys, "__pair"], "left_anti")
    both = have.unionByName(new, allowMissingColumns=True)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("place", F.lit(-1)), "__pair"))).drop("__pair")


def homeless(bouts: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Events that extra bouts are declared for and that aren't there; any row is a reason to stop."""
    return extra.select(*keys).distinct().join(bouts.select(*keys), keys, "left_anti")


def with_fractional_places(bouts: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """bouts with extra ones between them: places like 3.5, the last on the card first."""
    both = bouts.withColumn("place", F.col("place").cast("double")).unionByName(extra.withColumn("place", F.col("place").cast("double")))
    return both.withColumn("shown", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("place"), "a")))


def assembled(parsed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Parsed bouts without failures (no a or b) and non-professional ones; place counts from the end, and failed says how many failed."""
    bad = F.col("a").isNull() | F.col("b").isNull()
    told = parsed.withColumn("failed", F.count(F.when(bad, 1)).over(Window.partitionBy(*keys)))
    kept = told.where(~bad & classify.non_pro(F.col("heading")).isNull())
    w = Window.partitionBy(*keys)
    return kept.withColumn("place", (F.count("*").over(w) - F.row_number().over(w.orderBy(order)) + 1).cast("long"))


def corrected(bouts: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """bouts (fighter, date, opponent, fields) with corrections (fighter, date, opponent, field, value).

    A correction finds its rows by all three, but one of the date itself by fighter and opponent only.
    """
    pivot = lambda rows, keys, wanted: rows.groupBy(*keys).agg(*(F.max_by("value", F.when(F.col("field") == f, 1)).alias(f"__{f}") for f in wanted))
    others = [f for f in fields if f != "date"]
    full = pivot(corrections.where("field <> 'date'"), ["fighter", "date", "opponent"], others)
    part = pivot(corrections.where("field = 'date'"), ["fighter", "opponent"], ["date"])
    told = bouts.join(full, ["fighter", "date", "opponent"], "left").join(part, ["fighter", "opponent"], "left")
    return told.select(*(F.coalesce(f"__{c}", F.col(c).cast("string")).alias(c) if c in [*others, "date"] else F.col(c) for c in bouts.columns))


def rule_hits(rows: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """How often each rule (rule, keys) was matched; other than once is worth a look."""
    found = rules.join(rows.select(*keys, F.lit(1).alias("__one")), keys, "left")
    return found.groupBy("rule").agg(F.count("__one").alias("hits")).withColumn("as_expected", F.col("hits") == 1)


def guarded(previous: DataFrame, fresh: DataFrame, org: str, unit: str) -> DataFrame:
    """Fresh rows of each org, but the previous ones where fresh has none or under half as many units."""
    units = lambda rows, n: rows.groupBy(org).agg(F.count_distinct(unit).alias(n))
    seen = units(previous, "p").join(units(fresh, "f"), org, "full")
    ok = seen.where(F.col("f").isNotNull() & (F.col("p").isNull() | (F.col("f") >= F.col("p") / 2))).select(org)
    return fresh.join(ok, org, "left_semi").withColumn("kept_previous", F.lit(False)).unionByName(previous.join(ok, org, "left_anti").withColumn("kept_previous", F.lit(True)))


def prefer_rolled_up(shown: DataFrame, rolled: DataFrame) -> DataFrame:
    """shown (key, wins, losses, draws, no_record, needs_review, live, from_results) or, where that is the better one, rolled (key, wins, losses, draws)."""
    r = rolled.select("key", *(F.col(c).alias(f"__{c}") for c in ("wins", "losses", "draws")))
    total = lambda p: sum((F.coalesce(f"{p}{c}", F.lit(0)) for c in ("wins", "losses", "draws")), F.lit(0))
    rule = (
        F.when(F.col("no_record"), True)
        .when(F.col("needs_review") & ~F.col("live"), total("__") > 0)
        .when(~F.col("from_results"), False)
        .otherwise(total("__") > total(""))
    )
    told = shown.join(r, "key", "left").withColumn("rolled_up", rule & (total("__") > 0))
    return told.select("key", *(F.when(F.col("rolled_up"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("wins", "losses", "draws")), "rolled_up")


def rule_types(bouts: DataFrame, overrides: DataFrame) -> DataFrame:
    """bouts with the rule type that an override has for their event, date and pair."""
    return overridden_pairs(bouts, overrides, ["event", "date"], "a", "b", "rule_type")

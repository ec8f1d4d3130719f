"""Key differences, unordered pairs and duplicates by closeness of dates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that were added, removed or changed."""
    o = old.select(key, F.struct(*columns).alias("o"))
    n = new.select(key, F.struct(*columns).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, key, "full").select(key, kind.alias("change")).where("change is not null")


def unordered_pairs(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Each pair once for the other keys, whichever side is named first."""
    return rows.select(*keys, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def united(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Tables of several sources under shared columns, with the source of each row."""
    shaped = [rows.select(F.lit(name).alias("source"), *((F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in columns)) for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, shaped)


def keys_of_either(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()


def keys_of_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def latest_article(rows: DataFrame, keys: list[str], article: str) -> DataFrame:
    """Rows told by several articles once each: by the latest article that tells them."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(article)))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n")


MERGED = "fighter string, bout_id long, date date, opponent string, merged array<long>"


def near_date_merge(rows: DataFrame, days: int = 1) -> DataFrame:
    """Bouts of a fighter told more than once (fighter, bout_id, date, opponent, event).

    Equal days merge first; then a day or so apart where one event's name holds the other's; then rows
    without a date go to the only dated bout with that opponent. The survivor is the first; order
    matters, so a fighter's bouts are one group.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["bout_id"]).to_dict("records")
        kept: list[dict] = []
        for r in (r for r in rows if r["date"] is not None and not pd.isna(r["date"])):
            same = next((k for k in kept if k["opponent"] == r["opponent"] and (k["date"] == r["date"] or abs((k["date"] - r["date"]).days) <= days and _compatible(k["event"], r["event"]))), None)
            if same is None:
                kept.append(r | {"merged": []})
            else:
                same["merged"].append(r["bout_id"])
        for r in (r for r in rows if r["date"] is None or pd.isna(r["date"])):
            dated = [k for k in kept if k["opponent"] == r["opponent"]]
            if len(dated) == 1:
                dated[0]["merged"].append(r["bout_id"])
            else:
                kept.append(r | {"date": None, "merged": []})
        return pd.DataFrame(kept, columns=["fighter", "bout_id", "date", "opponent", "merged"])

    return rows.select("fighter", F.col("bout_id").cast("long").alias("bout_id"), "date", "opponent", "event").groupBy("fighter").applyInPandas(merge, MERGED)


def _compatible(a: str | None, b: str | None) -> bool:
    return a == b or bool(a and b and (a in b or b in a))


def constrained_union(rows: DataFrame, block: str) -> DataFrame:
    """Identities (key, entity) from roster rows (block, key, source, gym): rows of one name, in order of key,
    join the first entity that has none of their source and no other gym. A block is a name, so groups are small."""

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        entities: list[dict] = []
        out = []
        for r in frame.sort_values("key").to_dict("records"):
            fit = next((e for e in entities if r["source"] not in e["sources"] and (not r["gym"] or not e["gyms"] or r["gym"] in e["gyms"])), None)
            if fit is None:
                fit = {"id": r["key"], "sources": set(), "gyms": set()}
                entities.append(fit)
            fit["sources"].add(r["source"])
            if r["gym"]:
                fit["gyms"].add(r["gym"])
            out.append((r["key"], fit["id"]))
        return pd.DataFrame(out, columns=["key", "entity"])

    return rows.select(F.col(block).alias("block"), F.col("key").cast("string").alias("key"), "source", "gym").groupBy("block").applyInPandas(unite, "key string, entity string")

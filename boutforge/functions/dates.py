"""Calendar dates of one time zone, written as text or taken from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE_HOURS = 9
#: Weekdays from Sunday on.
WEEKDAYS = "日月火水木金土"


def local_date(utc: Column) -> Column:
    """The calendar date of a UTC timestamp (without zone) in the home zone."""
    return (utc + F.expr(f"INTERVAL {ZONE_HOURS} HOURS")).cast("date")


def local_midnight(utc: Column) -> Column:
    """The UTC moment at which that date begins."""
    return local_date(utc).cast("timestamp_ntz") - F.expr(f"INTERVAL {ZONE_HOURS} HOURS")


def days_until(date: Column, now_utc: Column) -> Column:
    return F.datediff(date.cast("date"), local_date(now_utc))


def date_text(date: Column) -> Column:
    return F.date_format(date, "yyyy年M月d日")


def date_and_weekday_text(date: Column) -> Column:
    return F.concat(date_text(date), F.lit("（"), F.substring(F.lit(WEEKDAYS), F.dayofweek(date), 1), F.lit("）"))


def month_text(date: Column) -> Column:
    return F.date_format(date, "yyyy年M月")


def shifted(date: Column, days: int) -> Column:
    return F.date_format(F.date_add(date.cast("date"), days), "yyyy-MM-dd")


def age(birth: Column, at: Column) -> Column:
    """Whole years; a birthday counts from its day on."""
    before = F.date_format(at, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(at) - F.year(birth) - before.cast("int")


def years_before(date: Column, years: int = 2) -> Column:
    """The same day some years before, as text: 29 February stays, whether or not there is one."""
    return F.concat(F.lpad((F.substring(date, 1, 4).try_cast("int") - years).cast("string"), 4, "0"), F.substr(date, F.lit(5)))


def is_calendar_date(text: Column) -> Column:
    """Whether text is YYYY-MM-DD and there is such a day."""
    return F.coalesce(text, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def valid_date(text: Column, page: Column) -> Column:
    """The date itself where it exists; else the first one in the page that does, then the date of publication."""
    found = F.transform(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"\d{4}年\d{1,2}月\d{1,2}日"), 0), _japanese)
    other = F.try_element_at(F.filter(found, is_calendar_date), F.lit(1))
    published = F.regexp_extract(F.coalesce(page, F.lit("")), r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1)
    return F.when(text.isNull() | is_calendar_date(text), text).otherwise(F.coalesce(other, F.when(is_calendar_date(published), published)))


def _japanese(text: Column) -> Column:
    part = lambda n: F.regexp_extract(text, r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日", n)
    return F.when(part(0) == "", "").otherwise(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def japanese_date(text: Column) -> Column:
    """YYYY-MM-DD from a date in words, empty where there is none."""
    return _japanese(text)


def template_date(text: Column) -> Column:
    """YYYY-MM-DD from {{dts|2026|May|9}}, {{dts|2026|5|9}} or {{dts|2023.12.31}}, empty for anything else."""
    piped = lambda n: F.regexp_extract(text, r"(?i)\{\{dts\|(\d{4})\|([A-Za-z0-9]+)\|(\d{1,2})", n)
    dotted = lambda n: F.regexp_extract(text, r"(?i)\{\{dts\|(\d{4})\.(\d{1,2})\.(\d{1,2})", n)
    named = F.date_format(F.try_to_date(F.concat(F.lit("1 "), F.initcap(piped(2)), F.lit(" 2000")), "d MMMM yyyy"), "MM")
    month = F.when(piped(2).rlike("^[0-9]+$"), F.lpad(piped(2), 2, "0")).otherwise(F.coalesce(named, F.lit("01")))
    return (
        F.when(piped(0) != "", F.concat_ws("-", piped(1), month, F.lpad(piped(3), 2, "0")))
        .when(dotted(0) != "", F.concat_ws("-", dotted(1), F.lpad(dotted(2), 2, "0"), F.lpad(dotted(3), 2, "0")))
        .otherwise("")
    )


def age_text(at: Column, now: Column) -> Column:
    """How long ago in words: now, minutes, hours or days."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 60)
    return (
        F.when(minutes < 1, "今")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("分前")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("時間前")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("日前")))
    )


def is_recent(at: Column, now: Column, hours: int = 3) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(at) < hours * 3600


def parsed_or_now(text: Column, now: Column) -> Column:
    """A timestamp from text; what is none counts as now."""
    return F.coalesce(F.try_to_timestamp(text), now)

"""Spans of regular expressions as columns, without Python.

A pattern's matches are marked in one replacement pass and the text is cut at the marks: odd parts are
matches, and running sums of the parts' lengths are their places in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
BLOCK = 256
NEIGHBOURS = 16  # parts that are looked through for what is around a match
SPAN = "array<struct<kind:string,start:int,end:int>>"


def without_marks(text: Column) -> Column:
    """Text in which the mark is another control character; no pattern tells the two apart."""
    return F.translate(text, MARK, "\u0002")


def marked(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def _before(lengths: Column, start: Column) -> Column:
    zero = F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"]


def starts(parts: Column) -> Column:
    """The place of each part."""
    return places(F.transform(parts, lambda x: F.char_length(x)))


def places(lengths: Column) -> Column:
    """The place of each part from the column of the parts' lengths; sums run within blocks, then over blocks, so many parts stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n))
    return F.flatten(F.zip_with(blocks, _before(totals, F.lit(0)), _before))


def _around(i: Column, tails: Column, heads: Column, width: int) -> Column:
    """The characters next to part i on either side, lower-cased; a few parts of at most width make them.

    Parts are taken one by one, since a slice would copy the whole array for each match.
    """
    before = F.concat_ws("", *(F.get(tails, i - k) for k in range(NEIGHBOURS, 0, -1)))
    after = F.concat_ws("", *(F.get(heads, i + k) for k in range(1, NEIGHBOURS + 1)))
    return F.lower(F.concat(F.right(before, F.lit(width)), F.lit(" "), F.left(after, F.lit(width))))


def matches(frame: DataFrame, text: str, patterns: dict[str, str], *, around: int = 0) -> DataFrame:
    """Add for each name an array of (text, start) of its matches, leftmost and not overlapping.

    With ``around`` a match also has that many characters from either side. They come from the parts
    next to it, so that a text of very many matches takes time in proportion to its length.
    """
    kind = "array<struct<text:string,start:int,around:string>>" if around else "array<struct<text:string,start:int>>"
    for name, pattern in patterns.items():
        parts = f"{name}_parts"
        frame = frame.withColumn(parts, marked(F.col(text), pattern))
        # a column of its own: within a lambda it would be made again for each block
        frame = frame.withColumn(f"{name}_lengths", F.when(F.size(parts) > 1, F.transform(parts, lambda x: F.char_length(x))))
        frame = frame.withColumn(f"{name}_starts", F.when(F.size(parts) > 1, places(F.col(f"{name}_lengths"))))
        zipped = F.arrays_zip(F.col(parts).alias("text"), F.col(f"{name}_starts").alias("start"))
        extra = []
        if around:
            some = lambda f: F.when(F.size(parts) > 1, F.transform(parts, f))
            frame = frame.withColumn(f"{name}_tails", some(lambda x: F.right(x, F.lit(around)))).withColumn(f"{name}_heads", some(lambda x: F.left(x, F.lit(around))))
            extra = [f"{name}_tails", f"{name}_heads"]
            near = lambda i: _around(i, F.col(extra[0]), F.col(extra[1]), around)
            zipped = F.transform(zipped, lambda x, i: F.struct(x["text"].alias("text"), x["start"].alias("start"), F.when(i % 2 == 1, near(i)).alias("around")))
        found = F.when(F.size(parts) > 1, F.filter(zipped, lambda x, i: i % 2 == 1)).otherwise(F.array().cast(kind))
        frame = frame.withColumn(name, found).drop(parts, f"{name}_lengths", f"{name}_starts", *extra)
    return frame


def spans(matched: Column, kind: str) -> Column:
    return F.transform(matched, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.char_length(m["text"])).alias("end")))


def ordered(all_spans: Column, kinds: list[str]) -> Column:
    """By start, then by the order of kinds."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"])
    return F.array_sort(
        all_spans,
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0),
    )


def joined(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long")

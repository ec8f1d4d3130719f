"""Where any of many names stand in texts, by an Aho-Corasick automaton.

Each text is read once for a batch of names, however many of them begin alike, and nothing is joined. Names are
taken in batches of about ``batch_bytes``, so what a worker holds is bounded however many names there are; a
batch is a pass over the texts and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "name string, place int, times int"


def places(texts: DataFrame, key: str, text: str, names: DataFrame, *, name: str = "name", whole: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """key, name, place (characters before its first place) and times (all places, overlapping ones too) of each name in each text.

    whole: only places with no letter or digit right before or after them. Null and empty names and texts give
    nothing; names that repeat count once; rows that repeat a key give rows of their own.
    """
    known = names.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct()
    total = known.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    batches = -(-total // batch_bytes)
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key), F.col(text).cast("string").alias("__text"))
    out = texts.sparkSession.createDataFrame([], f"{key} {kind}, {FOUND}")
    for b in range(batches):
        words = [r.name for r in known.where(F.pmod(F.xxhash64("name"), F.lit(batches)) == b).collect()]  # about batch_bytes
        if words:
            out = out.unionByName(rows.mapInArrow(_finder(texts.sparkSession.sparkContext.broadcast(words), key, whole), f"{key} {kind}, {FOUND}"))
    return out


def _finder(words, key: str, whole: bool):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            at: list[int] = []
            found: list[tuple[str, int, int]] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                seen: dict[str, list[int]] = {}
                for end, w in automaton.iter(text) if text else ():
                    start = end - len(w) + 1
                    if whole and (start and text[start - 1].isalnum() or end + 1 < len(text) and text[end + 1].isalnum()):
                        continue
                    if w in seen:
                        seen[w][0] = min(seen[w][0], start)
                        seen[w][1] += 1
                    else:
                        seen[w] = [start, 1]
                at += [row] * len(seen)
                found += [(w, *p) for w, p in seen.items()]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=[key, "name", "place", "times"])

    return find


def chips(found: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The first names of each text by place, the longer one where two begin together."""
    order = F.row_number().over(Window.partitionBy(key).orderBy("place", F.desc(F.char_length("name")), "name"))
    return found.withColumn("chip", order).where(F.col("chip") <= most)

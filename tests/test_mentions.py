"""Names in texts beside looking for each name in each text."""

import random

import pytest

from boutforge.operators import mentions


@pytest.mark.parametrize("whole, batch_bytes", [(False, 1 << 20), (True, 1 << 20), (False, 30)])
def test_places_of_many_names(spark, whole, batch_bytes):
    rng = random.Random(26)
    text = lambda n: "".join(rng.choice("ab é日-🙂") for _ in range(n))
    names = [text(rng.randint(1, 4)) for _ in range(60)] + ["aa", "aa", "a", None, ""]
    texts = [(k, text(rng.randint(0, 50))) for k in range(120)] + [(5, "aaaa"), (None, "aa"), (200, None), (201, ""), (202, "ab" * 100_000)]
    want = set()
    for n, (key, t) in enumerate(texts):
        for name in {x for x in names if x}:
            at = [i for i in range(len(t or "") - len(name) + 1) if t.startswith(name, i)]
            if whole:
                at = [i for i in at if not (i and t[i - 1].isalnum()) and not (i + len(name) < len(t) and t[i + len(name)].isalnum())]
            if at:
                want.add((n, key, name, at[0], len(at)))
    frame = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate(texts)], "n int, key int, t string")
    found = mentions.places(frame, "n", "t", spark.createDataFrame([(x,) for x in names], "name string"), whole=whole, batch_bytes=batch_bytes)
    assert {(r.n, texts[r.n][0], r.name, r.place, r.times) for r in found.collect()} == want
    assert mentions.places(frame.limit(0), "n", "t", frame.select("t"), name="t").count() == 0 == mentions.places(frame, "n", "t", frame.limit(0), name="t").count()


def test_chips_take_the_first_and_longest(spark):
    found = spark.createDataFrame([(1, "ab", 3, 1), (1, "abc", 3, 1), (1, "x", 9, 1), (1, "y", 0, 2), (2, "q", 5, 1)], "k int, name string, place int, times int")
    assert {(r.k, r.chip, r.name) for r in mentions.chips(found, "k").collect()} == {(1, 1, "y"), (1, 2, "abc"), (1, 3, "ab"), (2, 1, "q")}

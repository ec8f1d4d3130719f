"""Operator 4: personal data by patterns, checksums and nearby words; DataFrame functions only.

Patterns propose spans; validators confirm them: Luhn for card numbers, mod-97 for account numbers
(IBAN), ranges for addresses and digit counts for phones. Words that begin in a window around a span
raise or lower its score. Spans of the base kinds that pass their validators always stay; of the added kinds
(iban, and short cards, national phones and identity numbers) those with a score of 0.5 or more.

Defined cases: a null text is empty and has no spans; every row is kept, repeated ones too; extra
columns stay whatever their names, but one named like the output is replaced; time grows in proportion
to a text's length and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, tables

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "short_card", "local_phone", "identity"]
#: Possessive forms of the contract's patterns: nothing after them could make them give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+.)-])\(?0?[0-9]{2,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9-])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Beginnings of words near a span that speak for its kind.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|kontakt|courriel|correo",
    "ip": r"ip\b|host|server|address|adresse|login",
    "card": r"card|visa|master|credit|debit|karte|kreditkarte|carte|tarjeta|pay",
    "phone": r"tel\b|tel[eé]|phone|call|mobile|fax|handy|anruf|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "short_card": r"card|visa|master|credit|debit|karte|kreditkarte|carte|tarjeta|amex",
    "local_phone": r"tel\b|tel[eé]|phone|call|mobile|fax|handy|anruf|llam",
    "identity": r"ssn|social|insurance|tax\b|ident|passport",
}
#: Such beginnings that speak against any kind: numbers that are something else.
AGAINST = "order|isbn|version|serial|article|invoice|sku|example"
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "short_card": 0.3, "local_phone": 0.3, "identity": 0.35}
WINDOW, BONUS, MALUS, KEEP = 40, 0.3, 0.2, 0.5


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """Whether the account number's remainder is 1: letters count as 10 to 35, the first four characters go last."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, text: Column) -> Column:
    n = F.char_length(digits(text))
    octet = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", digits(text)),
        "phone": n.between(8, 15),
        "iban": mod97(text),
        "short_card": n.between(13, 15) & F.call_function("luhn_check", digits(text)),
        "local_phone": n.between(8, 12),
        "identity": ~text.rlike("^(?:000|666|9)"),
    }[kind]


def _score(kind: str, around: Column) -> Column:
    near = lambda words: around.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})")
    score = F.lit(PRIOR[kind]) + F.when(near(CONTEXT[kind]), BONUS).otherwise(0.0) - F.when(near(AGAINST), MALUS).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _confirmed(kind: str, matched: Column) -> Column:
    """The matches that pass the kind's validator, as scored spans; added kinds only with a high score."""
    end = lambda m: m["start"] + F.char_length(m["text"])
    fields = lambda m: (F.lit(kind).alias("kind"), m["start"].alias("start"), end(m).alias("end"), _score(kind, m["around"]).alias("score"))
    scored = F.transform(F.filter(matched, lambda m: _valid(kind, m["text"])), lambda m: F.struct(*fields(m)))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= KEEP)


def find(docs: DataFrame, *, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with an array of (kind, start, end, score) of all spans, by kind as listed and then start."""
    kept = [c for c in docs.columns if c != out]
    p = tables.unused([*docs.columns, out])
    source, digit = f"{p}text", f"{p}digit"
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), spans.without_marks(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias(source))
    # a digit or an at sign is in every span, and most texts have neither in plenty
    some = {"email": F.contains(source, F.lit("@")), "phone": F.contains(source, F.lit("+"))}
    frame = frame.withColumn(digit, F.col(source).rlike("[0-9]"))
    for kind, pattern in PATTERNS.items():
        frame = frame.withColumn(f"{p}in", F.when(some.get(kind, F.col(digit)), F.col(source)).otherwise(""))
        frame = spans.matches(frame, f"{p}in", {p + kind: pattern}, around=WINDOW).drop(f"{p}in")
    found = [_confirmed(kind, F.col(p + ("card" if kind == "short_card" else kind))) for kind in BASE + ADDED]
    return frame.withColumn(out, F.concat(*found)).select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{out}`"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each range of overlapping spans replaced by one kind in brackets.

    The whole range goes. It is named after its base span of highest score, then of most characters; after
    an added one only where no base span is in it. Spans that merely touch are ranges of their own.
    """
    rank = lambda s: F.struct(s["kind"].isin(BASE).alias("base"), s["score"].alias("score"), (s["end"] - s["start"]).alias("n"), s["kind"].alias("kind"))
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rank(s).alias("rank"))))
    none = F.lit(None).cast("struct<base:boolean,score:double,n:int,kind:string>")
    # a range stays open, from start to end, until a span begins at or behind its end
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("rank"), F.array().cast("array<string>").alias("out"))
    label = lambda a: F.when(a["rank"].isNull(), "").otherwise(F.concat(F.lit("["), a["rank"]["kind"], F.lit("]")))
    step = lambda a, s: F.when(
        a["rank"].isNotNull() & (s["start"] < a["end"]),
        F.struct(a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"), F.greatest(a["rank"], s["rank"]).alias("rank"), a["out"].alias("out")),
    ).otherwise(
        F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), F.concat(a["out"], F.array(F.concat(label(a), F.substring(text, a["end"] + 1, s["start"] - a["end"])))).alias("out")),
    )
    done = F.aggregate(order, zero, step)
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), label(done), F.substr(text, done["end"] + 1)))

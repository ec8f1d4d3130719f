"""Operator 2: secrets by patterns and a battery of randomness tests; DataFrame functions only.

Patterns find assignments, access keys and hexadecimal runs. Other long tokens are tested: an encoding
is inferred (hexadecimal of either case, bases 32, 36, 62 and 64), and under the hypothesis that
characters are drawn evenly from its alphabet three p-values are taken: chi-squared for uniformity, a runs test about the
alphabet's middle, and lag-one serial correlation. A token's p-value is the least of them times three.
In base 36 the share of digits is a fourth (few digits among letters are a name with a number).

Such a test only says what is not random, so a second p-value is taken under the opposite hypothesis:
that characters are drawn as unevenly as in words, names and numbers (WORDS: how much more often than
evenly two characters agree there). A token whose chi-squared is too low for that is no word.

In each stratum of encoding and length, over the whole corpus, two Benjamini-Hochberg step-ups at ALPHA
(from counts of p-values in fine bins) say which tokens are not random and which are no words. Secrets
are those that are no words and are not known to be unlike random ones, so that of what is called a secret
the expected share of words is at most ALPHA; a stratum of longer tokens, which differ more, has its own
thresholds, and where words abound a short token has to be further from them.

Defined cases: a null text is empty and has no spans; every row is kept, repeated ones too; extra columns
stay whatever their names, but one named like the output is replaced; equal p-values share a bin and so a
decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans, tables

BASE = ["assign", "access", "hex"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "candidate": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+(?![A-Za-z0-9+/_=-]))?+",
}
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SHORTEST = {"hex": 24, "base32": 24, "base36": 24, "base62": 24, "base64": 20}
LENGTHS = [20, 32, 48, 96, 1 << 30]
#: By how much two characters of words, names or numbers agree more often than even ones, in units of 1 / size.
WORDS = {"hex": 0.9, "base32": 1.1, "base36": 1.3, "base62": 2.7, "base64": 2.8}
ALPHA = 0.05
BINS = 400  # of the p-value's fourth root


def upper_tail(z: Column) -> Column:
    """The standard normal distribution's upper tail (a rational approximation, error below 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = F.greatest(F.lit(0.0), poly * F.exp(-x * x)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _sums(m: Column) -> dict[str, Column]:
    """What the three tests need of a token's places in its alphabet."""
    at, k = m["at"], m["k"]
    before, after = F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at))
    centre = (k - 1) / 2
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return {
        "n": F.size(at).cast("double"),
        "squares": add(F.transform(F.array_distinct(at), lambda c: F.pow(F.size(F.filter(at, lambda x: x == c)).cast("double"), F.lit(2.0)))),
        "high": add(F.transform(at, lambda x: (x * 2 >= k).cast("double"))),
        "digits": F.when(k == 36, add(F.transform(at, lambda x: (x < 10).cast("double")))),
        "changes": add(F.zip_with(before, after, lambda x, y: ((x * 2 >= k) != (y * 2 >= k)).cast("double"))),
        "variance": add(F.transform(at, lambda x: (x - centre) * (x - centre))),
        "lagged": add(F.zip_with(before, after, lambda x, y: (x - centre) * (y - centre))),
    }


def _deviates(m: Column) -> dict[str, Column]:
    """The tests' normal deviates: of chi-squared (Wilson and Hilferty), of runs about the middle, of lag one.

    That of words is by how much chi-squared lies below what uneven characters give (noncentral, its normal form).
    """
    k, n, high = m["k"], m["n"], m["high"]
    free = 2.0 / (9 * (k - 1))
    chi = F.greatest(m["squares"] * k / n - n, F.lit(0.0))
    mean = 2 * high * (n - high) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    uneven = m["uneven"] * n
    return {
        "uniform": (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - free)) / F.sqrt(free),
        "words": (k - 1 + uneven - chi) / F.sqrt(2 * (k - 1) + 4 * uneven),
        "runs": F.abs((m["changes"] + 1 - mean) / spread),
        "share": F.abs((m["digits"] - n * 10 / 36) / F.sqrt(n * 260 / 1296)),
        "serial": F.abs(m["lagged"] / F.greatest(m["variance"], F.lit(1e-9)) * F.sqrt(n)),
    }


def encoding(token: Column) -> Column:
    """The smallest alphabet that holds the token; none where only one kind of character occurs.

    Letters of one case with digits are base 36, of both cases without digits base 62. Base 64 takes all
    three kinds, and is the only one with signs between them.
    """
    classes = token.rlike("[0-9]").cast("int") + token.rlike("[a-z]").cast("int") + token.rlike("[A-Z]").cast("int")
    two = F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").when(token.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)=*$"), "base36").when(token.rlike("^[A-Za-z]+=*$"), "base62")
    return F.when(classes > 2, F.when(token.rlike("^[A-Za-z0-9+/_-]+=*$"), "base64")).when(classes > 1, two)


def _stratum(code: Column, length: Column) -> Column:
    band = sum(((length >= x).cast("int") for x in LENGTHS[:-1]), F.lit(0))
    return F.concat_ws("/", code, band.cast("string"))


def _tested(frame: DataFrame, p: str) -> DataFrame:
    """An array of (start, end, stratum, p, words) of the tokens whose encoding is known and length suffices.

    p is the p-value of even characters, words that of uneven ones; names begin with the prefix p.
    """
    coded = F.filter(F.transform(f"{p}candidate", lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), encoding(m["text"]).alias("code"))), lambda m: m["code"].isNotNull())
    frame = frame.withColumn(f"{p}coded", coded)
    # each step is a column of its own: a field is cheap to name often, an expression is not
    by_code = lambda m, values: F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), m["code"])
    shortest = lambda m: by_code(m, SHORTEST)
    one_case = lambda m: F.when(m["code"].isin("hex", "base36"), F.lower(m["text"])).otherwise(m["text"])
    plain = lambda m: F.regexp_replace(F.when(m["code"] == "base64", F.translate(m["text"], "-_", "+/")).otherwise(one_case(m)), "=+$", "")
    alphabet = lambda m: by_code(m, ALPHABETS)
    k = lambda m: by_code(m, {c: float(len(a)) for c, a in ALPHABETS.items()})
    keep = lambda m, *names: [m[x].alias(x) for x in names]
    long_enough = F.filter(f"{p}coded", lambda m: F.char_length(m["text"]) >= shortest(m))
    frame = frame.withColumn(
        f"{p}long",
        F.transform(
            long_enough,
            lambda m: F.struct(
                m["start"].alias("start"),
                (m["start"] + F.char_length(m["text"])).alias("end"),
                _stratum(m["code"], F.char_length(m["text"])).alias("stratum"),
                k(m).alias("k"),
                by_code(m, WORDS).alias("uneven"),
                alphabet(m).alias("alphabet"),
                plain(m).alias("plain"),
            ),
        ),
    )
    places = lambda m: F.transform(F.filter(F.split(m["plain"], ""), lambda c: c != ""), lambda c: F.instr(m["alphabet"], c) - 1)
    frame = frame.withColumn(f"{p}places", F.transform(f"{p}long", lambda m: F.struct(*keep(m, "start", "end", "stratum", "k", "uneven"), places(m).alias("at"))))
    frame = frame.withColumn(f"{p}sums", F.transform(f"{p}places", lambda m: F.struct(*keep(m, "start", "end", "stratum", "k", "uneven"), *(c.alias(n) for n, c in _sums(m).items()))))
    frame = frame.withColumn(f"{p}deviates", F.transform(f"{p}sums", lambda m: F.struct(*keep(m, "start", "end", "stratum", "n", "high"), *(c.alias(n) for n, c in _deviates(m).items()))))
    one_sided = lambda m: (m["high"] == 0) | (m["high"] == m["n"])
    runs = lambda m: F.when(one_sided(m), F.pow(F.lit(0.5), m["n"] - 1)).otherwise(2 * upper_tail(m["runs"]))
    tests = lambda m: F.when(m["share"].isNull(), 3.0).otherwise(4.0)
    # a null share is none of the least
    least = lambda m: F.least(F.lit(1.0), tests(m) * F.least(upper_tail(m["uniform"]), runs(m), 2 * upper_tail(m["serial"]), 2 * upper_tail(m["share"])))
    return frame.withColumn(f"{p}tested", F.transform(f"{p}deviates", lambda m: F.struct(*keep(m, "start", "end", "stratum"), least(m).alias("p"), upper_tail(m["words"]).alias("words"))))


def _bin(p: Column) -> Column:
    return F.least(F.floor(F.pow(p, F.lit(0.25)) * BINS), F.lit(BINS - 1)).cast("int")


def thresholds(tested: DataFrame, column: str) -> dict[str, tuple[int, int]]:
    """For each stratum the highest bins that are rejected as even and as words, -1 for none; a few rows, whatever the corpus.

    A bin counts as rejected if all p-values up to its upper end are at most ALPHA * rank / n.
    """
    token = tested.select(F.explode(column).alias("t"))
    value = F.explode(F.array(F.struct(F.lit(0).alias("test"), _bin(F.col("t.p")).alias("bin")), F.struct(F.lit(1).alias("test"), _bin(F.col("t.words")).alias("bin"))))
    counts = token.select(F.col("t.stratum").alias("stratum"), value.alias("v")).groupBy("stratum", "v.test", "v.bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum", "test")  # BINS rows each
    ranked = counts.select("stratum", "test", "bin", F.sum("n").over(by.orderBy("bin")).alias("rank"), F.sum("n").over(by).alias("total"))
    passed = F.pow((F.col("bin") + 1) / F.lit(BINS), F.lit(4.0)) <= ALPHA * F.col("rank") / F.col("total")
    highest = lambda test: F.max(F.when(passed & (F.col("test") == test), F.col("bin")).otherwise(-1))
    return {r[0]: (r[1], r[2]) for r in ranked.groupBy("stratum").agg(highest(0), highest(1)).collect()}


def find(docs: DataFrame, *, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end) of all spans by start; the kind random is the battery's."""
    kept = [c for c in docs.columns if c != out]
    p = tables.unused([*docs.columns, out])
    source, tested = f"{p}text", f"{p}tested"
    whole = spans.without_marks(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias(source)
    candidates = spans.matches(docs.select(whole), source, {f"{p}candidate": PATTERNS["candidate"]})
    limits = thresholds(_tested(candidates, p).where(F.size(tested) > 0), tested)
    frame = _tested(spans.matches(docs.select(*(F.col(f"`{c}`") for c in kept), whole), source, {p + k: x for k, x in PATTERNS.items()}), p)
    good = {"assign": F.filter(f"{p}assign", lambda m: F.char_length(F.regexp_extract(m["text"], VALUE, 1)) >= 8), "access": F.col(f"{p}access"), "hex": F.col(f"{p}hex")}
    frame = frame.withColumn(f"{p}base", F.concat(*(spans.spans(good[k], k) for k in BASE)))
    random = F.filter(tested, lambda t: F.lit(False))
    if limits:
        limit = [F.create_map(*(F.lit(x) for k, v in sorted(limits.items()) for x in (k, v[n]))) for n in (0, 1)]
        at = lambda n, t: F.coalesce(limit[n][t["stratum"]], F.lit(-1))
        random = F.filter(tested, lambda t: (_bin(t["p"]) > at(0, t)) & (_bin(t["words"]) <= at(1, t)))
    apart = F.filter(random, lambda t: ~F.exists(f"{p}base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    added = F.transform(apart, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return frame.withColumn(out, spans.ordered(F.concat(f"{p}base", added), [*BASE, "random"])).select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{out}`"))

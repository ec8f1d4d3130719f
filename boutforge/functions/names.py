"""Names: normal forms, kana, romanisation and pair keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for; by Arrow batch."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def squeezed(name: Column) -> Column:
    """Without white space and middle dots."""
    return F.regexp_replace(name, "[\\s　・]", "")


def bare(name: Column) -> Column:
    """Without white space, middle dots, stars and brackets with what they hold."""
    return F.regexp_replace(F.regexp_replace(name, "[(（][^)）]*[)）]", ""), "[\\s　・☆★]", "")


def nameless_quotes(name: Column) -> Column:
    """Without a quoted nickname."""
    return F.regexp_replace(name, "[\"“”'‘’「『][^\"“”'‘’」』]*[\"“”'‘’」』]", "")


def roster_key(name: Column) -> Column:
    """Compatible form, no nickname, no white space or symbols, variant characters unified, lower case."""
    plain = F.translate(squeezed(nameless_quotes(nfkc(name))), "髙﨑邊邉齋斎濱廣澤嶋", "高崎辺辺斉斉浜広沢島")
    return F.lower(F.regexp_replace(plain, "[-_.,=＝!！?？☆★]", ""))


#: Characters that are written for one another.
VARIANTS = ("髙﨑齋齊斎濵", "高崎斉斉斉浜")
LOOKALIKES = ("ニロカエト", "二口力工卜")
QUOTES = "\"'‘’“”〝〞〟′″「」『』・･·‧"


def kick_key(name: Column) -> Column:
    """The one key under which names meet: compatible form, no white space or quotes, variants and lookalikes unified, lower case."""
    plain = F.translate(F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), "[\\s　]", ""), QUOTES, "")
    return F.lower(F.translate(F.translate(plain, *VARIANTS), *LOOKALIKES))


def gym_key(gym: Column) -> Column:
    """A gym's name without the words that gyms have in common; null for nothing."""
    plain = F.translate(F.lower(nfkc(gym)), "“”\"'’‘`「」『』【】〈〉《》〔〕", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(plain, "ジム|gym|きっくぼくしんぐ|キックボクシング|kickboxing|道場|会館|team|チーム", ""), "[\\s　／/・\\-,、。]", ""), F.lit(""))


def reading_of_kana(name: Column) -> Column:
    """A name that is written in kana is its own reading, in katakana; null for any other."""
    bare_ = F.regexp_replace(F.coalesce(name, F.lit("")), "[\\s・ー.．＝=“”\"'’]", "")
    return F.when(bare_.rlike("^[ァ-ヺぁ-ゖ]+$"), to_katakana(bare_))


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def kana_row(kana: Column) -> Column:
    """The row of the kana table that a reading starts in; other for anything else."""
    first = F.substring(to_hiragana(kana), 1, 1)
    rows = [("[ぁ-お]", "あ"), ("[か-ご]", "か"), ("[さ-ぞ]", "さ"), ("[た-ど]", "た"), ("[な-の]", "な"), ("[は-ぽ]", "は"), ("[ま-も]", "ま"), ("[ゃ-よ]", "や"), ("[ら-ろ]", "ら"), ("[ゎ-ん]", "わ")]
    chain = None
    for pattern, label in rows:
        chain = F.when(first.rlike(pattern), label) if chain is None else chain.when(first.rlike(pattern), label)
    return chain.otherwise("他")


#: Readings of kana.
_ROMAJI = dict(
    zip(
        "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんがぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽ",
        "a i u e o ka ki ku ke ko sa shi su se so ta chi tsu te to na ni nu ne no ha hi fu he ho ma mi mu me mo ya yu yo ra ri ru re ro wa o n ga gi gu ge go za ji zu ze zo da ji zu de do ba bi bu be bo pa pi pu pe po".split(),
        strict=True,
    )
)


def romaji_of(text: str) -> str:
    """Small y-kana join the syllable before, a small tsu doubles the next consonant, long marks go."""
    plain = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)
    out, double = "", False
    for c in plain:
        if c == "っ":
            double = True
            continue
        if c == "ー":
            continue
        if c in "ゃゅょ" and out.endswith("i"):
            vowel = {"ゃ": "a", "ゅ": "u", "ょ": "o"}[c]
            out = out[:-1] + ("" if out[:-1].endswith(("sh", "ch", "j")) else "y") + vowel
            continue
        syllable = _ROMAJI.get(c, c)
        out += ("t" if syllable.startswith("ch") else syllable[:1]) + syllable if double and syllable[:1].isalpha() else syllable
        double = False
    return out


@F.pandas_udf(StringType())
def romaji(s: pd.Series) -> pd.Series:
    return s.map(romaji_of, na_action="ignore")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))

"""Grammars of results, names and events over texts that are composed of all line items' columns.

A text is written from numbers and words by one expression that both engines read; what must come out is told
by SQL from those numbers and words, not from the text. Columns: q quantity, p part, s supplier, n line,
f return flag, d shipping date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import classify, dates, names, results
from ..sources import pages
from .registry import query
from .testdata import table
from .texts import fields

_BASE = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, l_returnflag AS f, CAST(l_shipdate AS DATE) AS d FROM lineitem"


def composed(name: str, text: str, f: Callable[..., Column], value: str, second: str = "''", third: str = "''") -> None:
    """Register f over texts (and up to two further ones) of every line item; value is the SQL of what must come out."""

    def run(spark, sf_dir):
        kinds = {"n": "l_linenumber", "q": "l_quantity", "p": "l_partkey", "s": "l_suppkey"}
        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *(F.col(c).cast("bigint").alias(k) for k, c in kinds.items()), F.col("l_returnflag").alias("f"), F.col("l_shipdate").cast("date").alias("d"))
        made = rows.select("l_orderkey", "n", F.expr(text).alias("text"), F.expr(second).alias("second"), F.expr(third).alias("third"))
        given = [F.col(c) for c, e in (("text", text), ("second", second), ("third", third)) if e != "''"]
        return made.select("l_orderkey", "n", "text", f(*given).alias("value"))

    run.__name__ = name
    query(f"SELECT l_orderkey, n, {text} AS text, {value} AS value FROM ({_BASE}) b")(run)


_A, _B = [f"(25 + {x} % 6)" for x in ("q", "s", "(q + s)")], [f"(25 + {x} % 6)" for x in ("p", "n", "(p + n)")]
_RESULT = "CASE f WHEN 'A' THEN 'win' WHEN 'R' THEN 'loss' ELSE 'draw' END"
_WRONG = f"((f = 'A' AND {_A[0]} < {_B[0]}) OR (f = 'R' AND {_A[0]} > {_B[0]}))"
_SCORES = f"'判定' || {_A[0]} || '-' || {_B[0]} || '（' || {_A[1]} || '-' || {_B[1]} || '、' || {_A[2]} || '-' || {_B[2]} || '）'"
_TURNED = f"'判定' || {_B[0]} || '-' || {_A[0]} || '（' || {_B[1]} || '-' || {_A[1]} || '、' || {_B[2]} || '-' || {_A[2]} || '）'"

composed(
    "line_judges",
    " || ', ' || ".join(f"{a} || '-' || {b}" for a, b in zip(_A, _B, strict=True)),
    results.judges_favour,
    f"CASE WHEN {' + '.join(f'CAST({a} > {b} AS INT)' for a, b in zip(_A, _B, strict=True))} >= 2 THEN 'A' WHEN {' + '.join(f'CAST({a} < {b} AS INT)' for a, b in zip(_A, _B, strict=True))} >= 2 THEN 'B' ELSE 'tie' END",
)
composed(
    "line_scores",
    _SCORES,
    lambda t, r: fields(results.all_scores_in_perspective(t, r), "category", "text"),
    f"CASE WHEN f NOT IN ('A', 'R') THEN 'not_win_loss|' || {_SCORES} WHEN {_A[0]} = {_B[0]} THEN 'tied|' || {_SCORES} WHEN {_WRONG} THEN 'swapped|' || {_TURNED} ELSE 'already_correct|' || {_SCORES} END",
    _RESULT,
)
composed(
    "line_first_scores",
    f"n || 'R 判定 ' || {_A[0]} || '－' || {_B[0]} || ' ※' || q",
    results.score_in_perspective,
    f"CASE WHEN {_WRONG} THEN n || 'R 判定 ' || {_B[0]} || '-' || {_A[0]} || ' ※' || q ELSE n || 'R 判定 ' || {_A[0]} || '－' || {_B[0]} || ' ※' || q END",
    _RESULT,
)
composed(
    "line_finish_texts",
    f"CASE f WHEN 'A' THEN n || 'R ' || q || '’' || (10 + p % 50) || '”　 TKO' WHEN 'R' THEN '判定（' || {_A[0]} || '－' || {_B[0]} || '）' ELSE 'KO（技' || p || '）：' || n || 'R ' END",
    results.finish_text,
    f"CASE f WHEN 'A' THEN n || 'R ' || q || '分' || (10 + p % 50) || '秒 TKO' WHEN 'R' THEN '判定' || {_A[0]} || '-' || {_B[0]} ELSE 'KO(技' || p || '):' || n || 'R' END",
)
_LABELS = [  # raw text, and its label
    (f"n || 'R 判定 ' || {_A[0]} || '-' || {_B[0]}", f"'判定 ' || {_A[0]} || '-' || {_B[0]}"),
    ("n || 'R ' || (1 + q % 5) || '分' || (10 + p % 50) || '秒 TKO（ドクターストップ）'", "(1 + q % 5) || '分' || (10 + p % 50) || '秒 TKO(ドクターストップ)'"),
    (f"n || 'R+延長R終了 判定 ' || {_A[0]} || '-' || {_B[0]}", f"'延長R終了 判定 ' || {_A[0]} || '-' || {_B[0]}"),
    ("'再延長' || n || 'R KO (' || (1 + q % 5) || '分' || (10 + p % 50) || '秒) ※技' || p", "'再延長R KO ' || (1 + q % 5) || '分' || (10 + p % 50) || '秒'"),
    ("'勝者:N' || (s % 1000) || ' 【' || n || 'R】一本'", "'一本'"),
    ("'決着' || p", "'不明'"),
    ("'延長' || n || 'R'", "'—'"),
    (_SCORES, f"'判定' || {_A[0]} || '-' || {_B[0]} || '(' || {_A[1]} || '-' || {_B[1]} || '、' || {_A[2]} || '-' || {_B[2]} || ')'"),
]


def _chosen(key: str, options: list[str]) -> str:
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(options)) + " END"


composed("line_method_labels", _chosen("p", [raw for raw, _ in _LABELS]), results.method_label, _chosen("p", [label for _, label in _LABELS]))
composed("line_label_grammar", _chosen("q", [label for _, label in _LABELS if "'決着" not in label] + ["'KO?' || p", "'TKO ' || p || ' 号'", "'判定 ' || q || '-'"]), results.label_allowed, f"(q % {len(_LABELS) + 3}) < {len(_LABELS)}")
_WAYS = [("KO", "ko"), ("TKO", "tko"), ("判定", "decision"), ("三角絞め", "submission"), ("反則", "disqualification"), ("ノーコンテスト", "no_contest"), ("ドクターストップ", "doctor_stop"), ("謎", "other")]
composed(
    "line_methods",
    "CASE WHEN s % 2 = 0 THEN '延長' ELSE '' END || n || 'R ' || " + _chosen("p", [f"'{w}'" for w, _ in _WAYS]) + " || CASE WHEN q % 2 = 0 THEN ' ※MMA' ELSE '' END",
    lambda t: fields(results.parsed_method(t), "method", "round", "is_extension", "ruleset"),
    _chosen("p", [f"'{w}'" for _, w in _WAYS]) + " || '|' || n || CASE WHEN s % 2 = 0 THEN '|true|' ELSE '|false|' END || CASE WHEN q % 2 = 0 THEN 'mma' ELSE '-' END",
)
composed(
    "line_rules",
    "CASE p % 3 WHEN 0 THEN 'フェザー級' WHEN 1 THEN 'ライトヘビー級' ELSE '契約' END || ' ' || CASE WHEN s % 2 = 0 THEN 'MMAルール' ELSE 'キックルール' END || ' ' || (50 + q) || '.5kg'",
    lambda t: fields(results.rule_line(t), "rule_type", "weight_kg", "named_division"),
    "CASE WHEN s % 2 = 0 THEN 'MMA|' ELSE 'キックボクシング|' END || (50 + q) || '.5|' || CASE p % 3 WHEN 0 THEN 'フェザー級' WHEN 1 THEN 'ライトヘビー級' ELSE '-' END",
)
composed(
    "line_outcomes",
    _chosen("p", ["n || 'R ' || q || '分' || (p % 60) || '秒 TKO'", "'ノーコンテスト（体重超過）' || p", "n || 'R ドロー'", "'中止' || p", "'未定' || p"]),
    lambda t: fields(results.outcome(t, F.lit(""), F.lit("")), "result_type", "round", "time", "is_weigh_in_miss"),
    _chosen("p", ["'decisive|' || n || 'R|' || q || '分' || (p % 60) || '秒|false'", "'nc|-|-|true'", "'draw|-|-|false'", "'cancelled|-|-|false'", "'unknown|-|-|false'"]),
)
composed(
    "line_years",
    "CAST(d AS STRING)",
    results.date_with_year_of_title,
    "CASE WHEN p % 2 = 1 AND s % 3 > 0 THEN CAST(year(d) + 1 AS STRING) || substring(CAST(d AS STRING), 5) ELSE CAST(d AS STRING) END",
    "'大会' || (year(d) + p % 2) || ' ' || month(d) || '月' || (day(d) + CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END) || '日'",
)
composed(
    "line_no_contests",
    "CASE WHEN p % 2 = 0 THEN 'no_contest' ELSE 'decision' END",
    results.no_contest_by_text,
    f"CASE WHEN p % 2 = 0 AND q % 2 = 0 THEN 'no_contest' ELSE {_RESULT} END",
    "CASE WHEN q % 2 = 0 THEN '無効試合' ELSE '判定' END || s",
    _RESULT,
)
composed(
    "line_people",
    _chosen("p", ["'選手' || p || '・G' || s || 'ジム'", "'選手' || p || '（G' || s || '道場）'", "'選手' || p", "'選手' || p || '　' || 'Team G' || s"]),
    lambda t: fields(results.person_and_gym(t), "person", "gym"),
    _chosen("p", ["'選手' || p || '|G' || s || 'ジム'", "'選手' || p || '|G' || s || '道場'", "'-|-'", "'選手' || p || '|Team G' || s"]),
)
composed("line_events", "'Cup ' || p", results.events_compatible, "q % 2 = 0", "CASE WHEN q % 2 = 0 THEN 'CUP' || p || '　大会' ELSE 'cup' || (p + 1) || 'x' END")
composed("line_placeholders", _chosen("p", ["' T b A'", "'未　定'", "'選手' || p", "'不明' || p", "'不 明'"]), results.is_placeholder, "p % 5 IN (0, 1, 4)")
composed("line_event_tags", _chosen("p", ["'RIZIN.' || p || ' in 香川'", "'DEEP ' || p || ' IMPACT'", "'修斗 ' || p", "'rizin ' || p || ' 雷神'"]), results.event_tag, _chosen("p", ["'RIZIN_' || p", "'DEEP_' || p || 'IMPACT'", "'修斗' || p", "'RIZIN_' || p"]))
_EVENTS = [("K-1 WORLD", "K-1"), ("RISE", "RISE"), ("ARISE", classify.OTHER_PROMOTION), ("Glory", "GLORY"), ("武林风", "武林風"), ("武林風", classify.OTHER_PROMOTION), ("DEEP☆KICK", "DEEP☆KICK"), ("Wu Lin Feng", "武林風"), ("lumpinee", "ルンピニー")]
composed("line_promotions", _chosen("p", [f"'{e} ' || p" for e, _ in _EVENTS]), classify.promotion, _chosen("p", [f"'{o}'" for _, o in _EVENTS]))
_CLASSES = [("女子フライ級", None), ("メガトン級", "ヘビー級"), ("ライトヘビー級", "ヘビー級"), ("ウェルター級", None), ("バンタム級王座", "バンタム級"), ("ライト級", "ライト級")]
composed("line_five_classes", _chosen("p", [f"'第' || n || '代{c}'" for c, _ in _CLASSES]), classify.five_class, _chosen("p", [f"'{o}'" if o else "NULL" for _, o in _CLASSES]))
composed("line_calendar_dates", "(1990 + p % 40) || '-' || lpad(CAST(1 + s % 13 AS STRING), 2, '0') || '-' || lpad(CAST(26 + q % 7 AS STRING), 2, '0')", dates.is_calendar_date, "TRY_CAST((1990 + p % 40) || '-' || lpad(CAST(1 + s % 13 AS STRING), 2, '0') || '-' || lpad(CAST(26 + q % 7 AS STRING), 2, '0') AS DATE) IS NOT NULL")
composed("line_japanese_dates", "'開催' || year(d) || '年' || month(d) || '月 ' || day(d) || '日（土）'", dates.japanese_date, "CAST(d AS STRING)")
composed("line_templates", "'{{dts|' || year(d) || '|' || CASE WHEN p % 2 = 0 THEN CAST(month(d) AS STRING) ELSE " + _chosen("month(d)", [f"'{m}'" for m in ("december", "January", "February", "March", "April", "May", "JUNE", "July", "August", "September", "October", "November")]) + " END || '|' || day(d) || '}}'", dates.template_date, "CAST(d AS STRING)")
composed("line_kana", "translate(CAST(p * s AS STRING), '0123456789', 'あいうえおかきくけこ')", lambda t: F.concat_ws("|", names.to_katakana(t), names.to_hiragana(names.to_katakana(t))), "translate(CAST(p * s AS STRING), '0123456789', 'アイウエオカキクケコ') || '|' || translate(CAST(p * s AS STRING), '0123456789', 'あいうえおかきくけこ')")
composed("line_english", _chosen("p", ["'KO (punch ' || q || ')'", "'Submission (choke ' || q || ')'", "'Decision (' || q || '–' || n || ')'", "'TKO (' || q || ')'"]), classify.method_en, _chosen("p", ["'ko'", "'sub'", "'decision'", "'ko'"]))
composed("line_english_results", _chosen("p", ["'{{yes2}}Win'", "'{{no2}}Loss'", "'Draw'", "'NC'", "'Cancelled ' || p", "'?' || p"]), pages.result_in_english, _chosen("p", ["'win'", "'loss'", "'draw'", "'nc'", "NULL", "NULL"]))
composed("line_sections", "'前' || p || '【試合結果】' || q || CASE WHEN s % 2 = 0 THEN '【写真】後' ELSE '【次】後' END || s", lambda t: classify.section(t, "【試合結果】", ["【写真】", "【次】"]), "'【試合結果】' || q")
composed("line_event_kinds", _chosen("p", ["'DEEP KICK ' || p", "'アマチュアDEEP ' || p", "'DEEP ' || p"]), lambda t: F.concat_ws("|", classify.is_kick_event(t).cast("string"), classify.is_amateur_event(t).cast("string")), _chosen("p", ["'true|false'", "'false|true'", "'false|false'"]))
composed("line_kick_keys", "'髙﨑　' || translate(CAST(p AS STRING), '0123456789', '０１２３４５６７８９') || '・Ａ「ニ」'", names.kick_key, "'高崎' || p || 'a二'")
composed("line_gym_keys", "'Ｇ' || s || 'ジム / TEAM　' || translate(CAST(q AS STRING), '0123456789', '０１２３４５６７８９')", names.gym_key, "'g' || s || q")
composed("line_non_pro", _chosen("p", ["'アマチュア大会' || p", "'大会' || p", "'アマチュア ネオブラッド' || p"]), classify.non_pro, _chosen("p", ["'not_pro_amateur'", "NULL", "NULL"]))
composed("line_japanese_results", _chosen("p", ["'○'", "' × '", "'△'", "'－'", "'ー'", "'?' || p"]), pages.result_in_japanese, _chosen("p", ["'win'", "'loss'", "'draw'", "CASE WHEN q % 2 = 0 THEN NULL ELSE 'nc' END", "CASE WHEN q % 2 = 0 THEN NULL ELSE 'nc' END", "NULL"]), "CASE WHEN q % 2 = 0 THEN '試合中止' ELSE 'ノーコンテスト' END || s")
composed("line_rule_types", _chosen("p", ["'K-1ルール ' || p", "'MMA グラップリング ' || p", "'グラップリング' || p", "'試合' || p"]), lambda t: classify.rule_type(t, F.lit("")), _chosen("p", ["'キックボクシング'", "'MMA'", "'グラップリング'", "'MMA'"]))

"""Classifiers and scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, markup, names, scores
from .registry import query
from .testdata import table

_METHODS = ["", "—", "1R 1:08 KO（右ストレート）", "5分3R終了 判定3-0", "2R 3:44 リアネイキッドチョーク", "SUB（タップアウト）", "1R 0:40 N/A", "反則"]
_TITLES = ["計量結果", "出場予定選手が欠場", "一本勝ちで優勝", "対戦カード発表", "現役引退", "チケット情報", "コラム", "計量で欠場"]
_CLASSES = ["フェザー級", "71.0kg契約", "女子49kg", "ヘビー級", "80.0kg契約", "バンタム級王座", "", "120 kg"]


def _pick(values: list[str], column: str, n: int):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % n + 1).cast("int"))


def _pick_sql(values: list[str], column: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({column} % {len(values)} + 1 AS INTEGER))"


_SUB_JA = classify.SUBMISSION_JA
_NEWS_SQL = " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{k}'" for k, w in classify.NEWS_TYPES.items())


@query(f"""WITH m AS (SELECT p_partkey, {_pick_sql(_METHODS, "p_partkey")} AS m FROM part)
SELECT p_partkey, CASE WHEN trim(m) = '' THEN 'unknown' WHEN contains(m, '判定') THEN 'decision' ELSE 'finish' END AS class,
 trim(m) = '' OR trim(m) = '—' OR regexp_matches(trim(regexp_replace(trim(m), '^\\S*\\s+[\\d:]+\\s+', '')), '^(?i)N/A$') AS unknown,
 CASE WHEN regexp_matches(m, '^(?i)SUB') THEN 'sub' WHEN contains(m, '判定') THEN 'decision' WHEN regexp_matches(m, '(?i)KO') THEN 'ko' WHEN regexp_matches(m, '{_SUB_JA}') THEN 'sub' ELSE 'other' END AS kind,
 CASE WHEN contains(m, '判定') THEN 'decision' WHEN contains(m, 'KO') THEN 'ko' WHEN regexp_matches(m, '{classify.SUBMISSION_RESULT}') THEN 'sub' END AS from_results,
 CASE WHEN contains(m, '判定') THEN 'decision' WHEN regexp_matches(m, '(?i)KO') THEN 'ko' ELSE 'sub' END AS leftover FROM m""")
def method_classes(spark, sf_dir):
    m = table(spark, sf_dir, "part").select("p_partkey", _pick(_METHODS, "p_partkey", len(_METHODS)).alias("m"))
    c = F.col("m")
    return m.select("p_partkey", classify.method_class(c).alias("class"), classify.is_unknown_method(c).alias("unknown"), classify.method_kind(c).alias("kind"), classify.method_from_results(c).alias("from_results"), classify.method_leftover(c).alias("leftover"))


@query(f"""WITH n AS (SELECT event_id, ts, {_pick_sql(_TITLES, "event_id")} AS t, {_pick_sql(["rizin", "blog", "deep"], "user_id")} AS source, {_pick_sql(["none", "none", "force", "suppress"], "event_id // 8")} AS o FROM events),
k AS (SELECT *, CASE {_NEWS_SQL} ELSE 'article' END AS news_type, CASE WHEN source IN ('rizin', 'deep', 'shooto', 'pancrase') THEN 'official' ELSE 'media' END AS kind FROM n)
SELECT event_id, news_type, kind, CASE WHEN o = 'suppress' THEN false WHEN o = 'force' THEN true ELSE kind = 'official' AND news_type IN ('result', 'card_announcement', 'card_change', 'weigh_in', 'retirement_transfer') AND ts > TIMESTAMP '2024-01-29 00:00:00' END AS flash FROM k""")
def news_classes(spark, sf_dir):
    n = table(spark, sf_dir, "events").select("event_id", "ts", _pick(_TITLES, "event_id", 8).alias("t"), _pick(["rizin", "blog", "deep"], "user_id", 3).alias("source"), F.element_at(F.array(*map(F.lit, ["none", "none", "force", "suppress"])), (F.floor(F.col("event_id") / 8) % 4 + 1).cast("int")).alias("o"))
    k = n.withColumns({"news_type": classify.news_type(F.col("t")), "kind": classify.article_kind(F.col("source"))})
    return k.select("event_id", "news_type", "kind", classify.is_flash(F.col("kind"), F.col("news_type"), F.col("ts"), F.col("o"), F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")).alias("flash"))


@query(f"""WITH w AS (SELECT p_partkey, {_pick_sql(_CLASSES, "p_partkey")} AS w FROM part), k AS (SELECT *, TRY_CAST(nullif(regexp_extract(w, '(\\d+(?:\\.\\d+)?)\\s*kg', 1), '') AS DOUBLE) AS kg FROM w)
SELECT p_partkey, CASE WHEN regexp_matches(w, '女子|アトム|JEWELS') THEN NULL WHEN regexp_matches(w, 'ウェルター|ミドル|ライトヘビー') THEN NULL WHEN regexp_matches(w, 'ヘビー級|メガトン|スーパーヘビー') THEN 'ヘビー級' WHEN regexp_matches(w, 'ストロー級|フライ級') THEN 'フライ級' WHEN contains(w, 'バンタム級') THEN 'バンタム級' WHEN contains(w, 'フェザー級') THEN 'フェザー級' WHEN contains(w, 'ライト級') THEN 'ライト級'
 WHEN kg <= 57.5 THEN 'フライ級' WHEN kg <= 61.5 THEN 'バンタム級' WHEN kg <= 66.5 THEN 'フェザー級' WHEN kg <= 71.5 THEN 'ライト級' WHEN kg >= 93 THEN 'ヘビー級' END AS division FROM k""")
def weight_divisions(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_partkey", _pick(_CLASSES, "p_partkey", 8).alias("w"))
    return w.select("p_partkey", classify.division(F.col("w")).alias("division"))


_LABELS = {"widget": "widget", "bolt": "bolt", "promo": "PROMO", "small": "small"}


@query("""WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS t FROM part), h AS (SELECT p_partkey, unnest([{'at': instr(t, 'bolt'), 'label': 'bolt'}, {'at': instr(t, 'PROMO'), 'label': 'promo'}, {'at': instr(t, 'small'), 'label': 'small'}, {'at': instr(t, 'widget'), 'label': 'widget'}]) AS x FROM t)
SELECT t.p_partkey, (SELECT arg_min(x.label, (x.at, x.label)) FROM h WHERE h.p_partkey = t.p_partkey AND x.at > 0) AS label FROM t""")
def earliest_labels(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return t.select("p_partkey", classify.earliest_label(F.col("t"), _LABELS).alias("label"))


@query("""SELECT p_partkey, CASE WHEN abs(p_size - 10) <= abs(p_size - 20) AND abs(p_size - 10) <= abs(p_size - 40) THEN 'light' WHEN abs(p_size - 20) <= abs(p_size - 40) THEN 'middle' ELSE 'heavy' END AS nearest FROM part""")
def nearest_limits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", classify.nearest_limit(F.col("p_size").cast("double"), {"light": 10.0, "middle": 20.0, "heavy": 40.0}).alias("nearest"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal + 1000 = 0 THEN 0.5 ELSE greatest(CAST(0.08 AS DOUBLE), least(CAST(0.92 AS DOUBLE), 500 / (500 + c_acctbal + 1500))) END AS share, floor(c_acctbal / 10 + 0.5) * 10 AS shown, round(1 / (1 + pow(CAST(10 AS DOUBLE), (c_acctbal - 1500) / 400)), 6) AS expected FROM customer""")
def score_functions(spark, sf_dir):
    c = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", scores.tug_share(F.lit(500.0), c + 1500).alias("share"), (scores.half_up(c / 10) * 10).alias("shown"), F.round(scores.expected_score(F.lit(1500.0), c), 6).alias("expected"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[^\\x{0000}-\\x{00ff}]', '', 'g')) AS DOUBLE) * -0.5 + length(text) AS width FROM documents")
def display_widths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", markup.display_width(F.col("text")).alias("width"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(regexp_replace(c_name || '(' || c_mktsegment || ') ☆', '[(（][^)）]*[)）]', '', 'g'), '[\\s　・☆★]', '', 'g') AS bare FROM customer")
def name_keys(spark, sf_dir):
    n = table(spark, sf_dir, "customer")
    return n.select("c_custkey", names.slug(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).alias("slug"), names.bare(F.concat("c_name", F.lit("("), "c_mktsegment", F.lit(") ☆"))).alias("bare"))

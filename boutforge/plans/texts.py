"""Functions over texts and dates; where SQL has no such grammar, the expected values are written out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import classify, dates, results
from .registry import query
from .testdata import table


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def worked(name: str, cases: list[tuple], f: Callable[[Column], Column]) -> None:
    """Register f over the first members of cases, dealt to the parts; the second members are what must come out."""
    n = len(cases)
    sql = f"SELECT p_partkey, list_extract([{', '.join(_literal(out) for _, out in cases)}], CAST(p_partkey % {n} + 1 AS INTEGER)) AS value FROM part"

    def run(spark, sf_dir):
        taken = F.element_at(F.array(*(F.lit(text) for text, _ in cases)), (F.col("p_partkey") % n + 1).cast("int"))
        return table(spark, sf_dir, "part").select("p_partkey", taken.alias("text")).select("p_partkey", f(F.col("text")).alias("value"))

    run.__name__ = name
    query(sql)(run)


def fields(struct: Column, *names: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(struct[n].cast("string"), F.lit("-")) for n in names))


def _two(text: Column, n: int) -> Column:
    return F.element_at(F.split(text, "#"), n)


worked(
    "finish_texts",
    [("3R 4’31” TKO", "3R 4分31秒 TKO"), ("判定（3－0）", "判定3-0"), ("[判定：2-1]", "判定2-1"), ("判定 5-0 ※延長", "判定5-0 ※延長"), ("KO（右フック）：1R", "KO(右フック):1R"), ("  TKO　 1R  3分50秒 ", "TKO 1R 3分50秒"), ("1R 3'13”秒", "1R 3'13”秒"), ("SUB ロック", "SUB ロック")],
    results.finish_text,
)
worked(
    "method_labels",
    [("3R 判定", "判定"), ("1RKO", "KO"), ("延長1R 判定 3-0", "判定 3-0"), ("※MMA 一本", "不明"), ("2R 1分10秒 TKO（ドクターストップ）", "1分10秒 TKO(ドクターストップ)"), ("", "—"), ("何か知らない文", "不明"), ("判定ドロー※補足", "判定ドロー"), ("3R終了時 判定負け", "判定負け")],
    results.method_label,
)
worked("label_grammar", [("KO", True), ("判定 3-0", True), ("判定(30-29、30-29、29-30)", True), ("試合前", True), ("KO?", False), ("関係ない文", False), ("勝者:山田 判定", True)], results.label_allowed)
worked(
    "scores_in_perspective",
    [("判定0-3#win", "判定3-0"), ("判定0-3#loss", "判定0-3"), ("判定 29－30#win", "判定 30-29"), ("判定1-1#win", "判定1-1"), ("3R 判定3-0 ※2#loss", "3R 判定0-3 ※2"), ("KO 1R#win", "KO 1R"), ("判定3-0#draw", "判定3-0")],
    lambda t: results.score_in_perspective(_two(t, 1), _two(t, 2)),
)
worked(
    "all_scores_in_perspective",
    [("判定0-3(28-30、27-30)#win", "判定3-0(30-28、30-27)|swapped"), ("判定3-0(30-28)#win", "判定3-0(30-28)|already_correct"), ("判定 29-29#loss", "判定 29-29|tied"), ("KO#win", "KO|no_score"), ("判定0-3#draw", "判定0-3|not_win_loss"), ("判定0-3 1名#win", "判定3-0 1名|swapped_main_only"), ("判定28と30#win", "判定28と30|unparseable")],
    lambda t: fields(results.all_scores_in_perspective(_two(t, 1), _two(t, 2)), "text", "category"),
)
worked(
    "parsed_methods",
    [("3R 判定", "decision|3|false|-"), ("延長1R TKO", "tko|1|true|-"), ("1R KO ※MMA", "ko|1|false|mma"), ("不戦勝", "walkover|-|false|-"), ("2R ノーコンテスト", "no_contest|2|false|-"), ("OFG 裸絞め", "submission|-|false|ofg"), ("※注", "-|-|false|-"), ("2R終了時", "time_limit|2|false|-"), ("中止", "-|-|false|-"), ("謎", "other|-|false|-")],
    lambda t: fields(results.parsed_method(t), "method", "round", "is_extension", "ruleset"),
)
worked(
    "outcomes",
    [("1R 4分20秒 TKO#○#", "decisive|1R|4分20秒|false"), ("ノーコンテスト（体重超過）##", "nc|-|-|true"), ("3R ドロー#△#", "draw|-|-|false"), ("##中止のお知らせ", "cancelled|-|-|false"), ("未定##", "unknown|-|-|false"), ("判定#○#", "decisive|-|-|false"), ("1R KO#NC#", "nc|-|-|false")],
    lambda t: fields(results.outcome(_two(t, 1), _two(t, 2), _two(t, 3)), "result_type", "round", "time", "is_weigh_in_miss"),
)
worked(
    "rule_lines",
    [("MMAルール 5分3R 66.0kg", "MMA|66.0|-"), ("フェザー級 キックルール", "キックボクシング|-|フェザー級"), ("", "unknown|-|-"), ("ライトヘビー級 93kg", "MMA|93.0|ライトヘビー級"), ("グラップリング", "グラップリング|-|-")],
    lambda t: fields(results.rule_line(t), "rule_type", "weight_kg", "named_division"),
)
worked(
    "years_by_title",
    [("2015-05-06#大会2016 5月6日", "2016-05-06"), ("2015-05-06#大会2016 5月7日", "2015-05-06"), ("2015-05-06#2015と2016 5月6日", "2015-05-06"), ("2015-05-06#2014から2016 5月6日", "2015-05-06"), ("2015-05-06#大会", "2015-05-06"), ("2015#2016 5月6日", "2015")],
    lambda t: results.date_with_year_of_title(_two(t, 1), _two(t, 2)),
)
worked(
    "no_contests_by_text",
    [("no_contest#ノーコンテスト#draw", "no_contest"), ("no_contest#無効試合#loss", "no_contest"), ("decision#無効#win", "win"), ("no_contest#判定#win", "win"), ("no_contest#無効#cancelled", "cancelled")],
    lambda t: results.no_contest_by_text(_two(t, 1), _two(t, 2), _two(t, 3)),
)
worked("judge_majorities", [("※10-9, 10-9, 9-10", "A"), ("9-10、9-10", "B"), ("10-9, 9-10", "tie"), ("10-10, 10-9", "tie"), ("なし", None), ("29-28 / 28-29 / 30-27", "A")], results.judges_favour)
worked(
    "people_and_gyms",
    [("山田太郎・東京ジム", "山田太郎|東京ジム"), ("ペットモラコットTeam ABC", None), ("山田（大阪道場）", "山田|大阪道場"), ("山田太郎", None), ("センチャイKTジム", "センチャイ|KTジム"), ("ジム", None)],
    lambda t: F.when(results.person_and_gym(t).isNotNull(), fields(results.person_and_gym(t), "person", "gym")),
)
worked("event_pairs", [("RIZIN 50#rizin50", True), ("DEEP 120 IMPACT#DEEP120", True), ("RIZIN 50#RIZIN 51", False), ("#RIZIN", False)], lambda t: results.events_compatible(_two(t, 1), _two(t, 2)))
worked("placeholders", [("不明", True), ("TBA", True), ("未 定", True), ("山田", False)], results.is_placeholder)
worked("event_tags", [("RIZIN.50 in 香川", "RIZIN_50"), ("DEEP 120 IMPACT", "DEEP_120IMPACT"), ("修斗 2026", "修斗2026"), ("RIZIN 49 雷神番外地", "RIZIN_49"), ("PANCRASE", "PANCRASE")], results.event_tag)
worked("result_titles", [("山田が新王者に", True), ("山田が一本勝ち", True), ("カード発表", False), ("全試合結果", True)], results.tells_result)
worked("mma_titles", [("RIZIN.50", True), ("deeper insight", False), ("DEEP132結果", True), ("INDEEP", False), ("ONE Friday Fights 3", True), ("one day", False), ("MMA", True), ("MMAX", False), ("修斗", True)], classify.is_mma)
worked("promotions", [("K-1 WORLD", "K-1"), ("RISE 100", "RISE"), ("ARISE", "Wikipedia(その他団体)"), ("ONE 160: X", "ONE Championship"), ("One Night", "Wikipedia(その他団体)"), ("DEEP☆KICK 50", "DEEP☆KICK"), ("Glory 80", "GLORY"), ("武林风 2018", "武林風"), ("武風林", "武林風"), ("武林風", "Wikipedia(その他団体)"), ("全日本キックボクシング連盟", "全日本キックボクシング連盟")], classify.promotion)
worked("five_classes", [("女子フライ級", None), ("メガトン級", "ヘビー級"), ("ライトヘビー級", "ヘビー級"), ("ウェルター級", None), ("バンタム級王座", "バンタム級"), ("ライト級", "ライト級"), ("", None)], classify.five_class)
worked("class_orders", [("フライ級", 56.7), ("女子アトム級", 1047.6), ("ヘビー級", 120.2), ("無差別級", 9999.0)], classify.class_order)
worked("rank_orders", [("王者", -2), ("暫定王者", -1), ("1", 1), ("10位", 10), ("空位", 999)], classify.rank_order)
worked("event_kinds", [("DEEP KICK 1", "true|false"), ("アマチュアDEEP", "false|true"), ("DEEP 100", "false|false")], lambda t: F.concat_ws("|", classify.is_kick_event(t).cast("string"), classify.is_amateur_event(t).cast("string")))
worked("result_sections", [("前【試合結果】本文【写真】後", "【試合結果】本文"), ("【試合結果】a【次】b【写真】", "【試合結果】a"), ("なし", "なし"), ("【試合結果】全部", "【試合結果】全部")], lambda t: classify.section(t, "【試合結果】", ["【写真】", "【次】"]))
worked(
    "series_keys",
    [("rizin#RIZIN.50", "rizin.50"), ("rizin#LANDMARK 11", "landmark.11"), ("pancrase#PANCRASE 350", "pancrase.350"), ("pancrase#PANCRASE BLOOD 3", None), ("deep#DEEP 120 IMPACT", "deep.120"), ("deep#DEEP TOKYO IMPACT 2026 3", "tokyo-impact.2026.3"), ("shooto#Vol.3", "vol.3"), ("deep#DEEP", None)],
    lambda t: classify.series_key(_two(t, 1), _two(t, 2)),
)
worked("calendar_dates", [("2024-02-29", True), ("2025-02-29", False), ("2025-11-31", False), ("2025-1-1", False), ("", False), ("2025-12-31", True)], dates.is_calendar_date)
worked(
    "rescued_dates",
    [("2025-02-29#訂正2025年2月30日、2025年3月1日", "2025-03-01"), ("2025-03-02#2025年3月1日", "2025-03-02"), ('2025-02-29#"datePublished": "2025-02-20"', "2025-02-20"), ("2025-02-29#なし", None)],
    lambda t: dates.valid_date(_two(t, 1), _two(t, 2)),
)
worked("template_dates", [("{{dts|2026|May|9}}", "2026-05-09"), ("{{dts|2026|5|9}}", "2026-05-09"), ("{{dts|2023.12.31}}", "2023-12-31"), ("{{dts|2026|Foo|9}}", "2026-01-09"), ("2026", "")], dates.template_date)
worked("japanese_dates", [("2026年7月 18日（土）", "2026-07-18"), ("2026年12月1日", "2026-12-01"), ("日付なし", "")], dates.japanese_date)
worked("shown_dates", [("2026-02-28", "2026年2月28日（土）|2026年2月|2026-03-01"), ("2026-12-31", "2026年12月31日（木）|2026年12月|2027-01-01")], lambda t: F.concat_ws("|", dates.date_and_weekday_text(t.cast("date")), dates.month_text(t.cast("date")), dates.shifted(t, 1)))


@query("""SELECT event_id, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, CAST(datediff('day', CAST(TIMESTAMP '2024-01-20 18:30:00' + INTERVAL 9 HOUR AS DATE), DATE '2024-02-01') AS INTEGER) AS days_left, datediff('second', ts, TIMESTAMP '2024-01-30 00:00:00') < 10800 AS recent,
 CASE WHEN m < 1 THEN '今' WHEN m < 60 THEN CAST(m AS VARCHAR) || '分前' WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || '時間前' ELSE CAST(m // 1440 AS VARCHAR) || '日前' END AS age FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-01-30 00:00:00') // 1000000 - epoch_us(ts) // 1000000) / 60.0) AS BIGINT) AS m FROM events)""")
def event_days(spark, sf_dir):
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        dates.local_date(ts).cast("string").alias("day"),
        dates.days_until(F.lit("2024-02-01"), F.expr("TIMESTAMP_NTZ '2024-01-20 18:30:00'")).alias("days_left"),
        dates.is_recent(ts, now).alias("recent"),
        dates.age_text(ts, now).alias("age"),
    )


@query("SELECT o_orderkey, CAST(date_part('year', DATE '2024-03-01') - date_part('year', o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0301' THEN 1 ELSE 0 END AS INTEGER) AS age, CAST(date_part('year', o_orderdate) - 2 AS VARCHAR) || strftime(o_orderdate, '-%m-%d') AS two_years_before FROM orders")
def ages(spark, sf_dir):
    born = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.age(born, F.lit("2024-03-01").cast("date")).alias("age"), dates.years_before(F.date_format(born, "yyyy-MM-dd")).alias("two_years_before"))

"""First-match classifiers and predicates over text columns.

Several classify the same thing differently on purpose: each belongs to its own source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
SUBMISSION_JA = "絞め|クランク|固め|三角|チョーク|腕ひしぎ|ロック|一本|スリーパー|ホールド|ヒール|アームバー|オモプラッタ|アメリカーナ|ツイスター|ネックシザース|洗濯ばさみ|サブミッション|スロエフ|ニーバー|ストレッチ"
SUBMISSION_RESULT = "絞|締|固め|十字|チョーク|三角|アーム|ヒール|フック|ツイスター|一本|サブミッション|リアネイキッド|スリーパー|ギロチン|バック"
WEIGH_IN_MISS = "計量.*(オーバー|失敗|未達)|オーバーウェイト"
NON_MMA_EVENT = "(?i)キックルール|kickboxing|エキシビション|exhibition"
NEWS_TYPES = {
    "weigh_in": ["計量"],
    "card_change": ["欠場", "負傷欠場", "カード変更", "対戦カード変更", "変更カード", "中止カード", "カード中止", "試合中止", "代替出場", "対戦相手変更"],
    "result": ["試合結果", "全試合結果", "大会結果", "KO勝", "TKO勝", "一本勝", "判定勝", "判定で", "下し", "破り", "破って", "制し", "撃破", "秒殺", "優勝", "王座奪取", "新王者", "王座防衛", "防衛成功", "勝利", "敗北", "返り討ち"],
    "card_announcement": ["カード決定", "対戦決定", "対戦カード決定", "カード発表", "対戦カード発表", "追加カード", "追加対戦カード", "対戦相手決定", "出場決定", "参戦決定", "参戦発表", "メイン決定", "メインイベント決定", "タイトルマッチ決定", "王座決定戦", "調印", "対戦が決定", "実現"],
    "retirement_transfer": ["引退", "現役引退", "移籍", "契約解除", "電撃移籍", "再契約", "電撃契約", "契約合意", "FA宣言"],
    "announcement_minor": [
        "ポスター", "ビジュアル", "壁紙", "前売", "チケット", "観覧募集", "見所", "見どころ", "煽り", "予告動画", "PV公開", "グッズ", "物販", "放送", "配信スケジュール", "テレビ", "TV", "放送日", "スケジュール", "キャンペーン", "公開練習", "合同練習", "記者会見", "会見", "囲み取材",
        "セミナー", "アワード", "表彰", "殿堂", "握手会", "サイン会", "ファンイベント", "試合順", "カウントダウン",
    ],
}
FLASH_TYPES = ["result", "card_announcement", "card_change", "weigh_in", "retirement_transfer"]
OFFICIAL_SOURCES = ["rizin", "deep", "shooto", "pancrase"]
NON_PRO = {
    "non_mma_karate": ["新空手", "CKC"],
    "non_mma_kids_shooto": ["キッズ", "ジュニア"],
    "non_mma_submission_only": ["寝試合"],
    "not_pro_amateur": ["アマ", "IMMAF", "JMMAF"],
    "not_pro_tryout": ["トライアウト"],
    "not_pro_cage_gate": ["CAGE GATE", "CAGEGATE"],
    "not_pro_pancrase_gate": ["パンクラスゲート", "パンクラス・ゲート", "パンクラス ゲート", "パンクラス　ゲート", "PANCRASEゲート"],
    "not_pro_futureking": ["フューチャーキング"],
    "not_pro_promotion_tournament": ["プロ昇格"],
}
EXEMPT_TOURNAMENT = "(?i)ネオブラッド|NEO BLOOD"
RULE_TYPES = [
    (r"(?i)キックボクシ|Kickboxing|ISKA|K-?1(?!グ)|キック(ルール|戦)", "キックボクシング"),
    (r"(?i)シュートボクシング|SB\s*ルール", "シュートボクシング"),
    ("グラップリング|柔術", "グラップリング"),
    ("ベアナックル", "ベアナックル"),
    ("スタンディングバウト", "スタンディングバウト"),
    ("エキシビ|エキジビ", "エキシビジョン"),
    ("(?i)MIXルール", "MIXルール"),
    (r"チャレンジ\s*ルール", "チャレンジルール"),
    ("プロレスルール", "プロレスルール"),
]

MMA_WORDS = ["(?i:RIZIN)", "ライジン", "(?i:UFC)", "(?i:(?<![A-Za-z])DEEP(?![A-Za-z]))", "パンクラス", "(?i:PANCRASE)", "修斗", r"(?i:ONE\s?(?:Championship|FC|Friday Fights))", "(?i:PFL)", "(?i:Bellator)", "ベラトール", "総合格闘技", r"\bMMA\b", "グラップリング", "(?i:ADCC)"]
PROMOTIONS = [
    ("(?i)K-?1|Krush", "K-1"),
    (r"\bRISE\b|R\.I\.S\.E\.", "RISE"),
    ("SHOOT ?BOXING|シュートボクシング", "SHOOT BOXING"),
    ("KNOCK ?OUT", "KNOCK OUT"),
    ("RIZIN", "RIZIN"),
    (r"\bONE\b.*(Champ|FC)|ONE\d|^ONE\b", "ONE Championship"),
    ("DEEP.?KICK", "DEEP☆KICK"),
    ("NJKF|ニュージャパンキックボクシング連盟", "NJKF"),
    ("(?i)HOOST ?CUP", "HoostCup"),
    (r"\bNKB\b", "NKB"),
    ("(?i)Big ?bang|ビッグバン", "Bigbang"),
    ("(?i)Stand ?up", "Stand up"),
    ("(?i)KROSS.?OVER", "KROSS×OVER"),
    ("SNKA|新日本キックボクシング協会", "SNKA"),
    (r"\bJKA\b|ジャパンキックボクシング協会", "JKA"),
]
FURTHER_PROMOTIONS = [
    (r"(?i)\bGLORY\b", "GLORY"),
    ("(?i)ラジャダムナン|Rajadamnern", "ラジャダムナン"),
    ("(?i)ルンピニー|Lumpinee", "ルンピニー"),
    ("(?i)Thai ?Fight", "Thai Fight"),
    ("(?i)IT'?S SHOWTIME", "IT'S SHOWTIME"),
    ("(?i)武林风|武風林|Wu ?Lin ?Feng", "武林風"),
    ("(?i)EM Legend", "EM Legend"),
    ("(?i)WAKO|SuperLeague", "WAKO SuperLeague"),
    ("全日本キックボクシング連盟", "全日本キックボクシング連盟"),
    ("(?i)J-NETWORK", "J-NETWORK"),
]
OTHER_PROMOTION = "Wikipedia(その他団体)"
FIVE_CLASSES = [("女子|アトム", None), ("メガトン|スーパーヘビー|ヘビー級", "ヘビー級"), ("ストロー|ウェルター|ミドル|ライトヘビー", None), ("フライ級", "フライ級"), ("バンタム級", "バンタム級"), ("フェザー級", "フェザー級"), ("ライト級", "ライト級")]
CLASS_KG = {"ストロー級": 52.2, "フライ級": 56.7, "バンタム級": 61.2, "フェザー級": 65.8, "ライト級": 70.3, "ウェルター級": 77.1, "ミドル級": 83.9, "ライトヘビー級": 93.0, "ヘビー級": 120.2, "メガトン級": 120.2, "スーパーヘビー級": 120.2}
WOMEN_KG = {"女子ミクロ級": 44.0, "女子アトム級": 47.6, "女子スーパーアトム級": 50.0, "女子ストロー級": 52.2, "女子フライ級": 56.7, "女子バンタム級": 61.2, "女子フェザー級": 65.8}


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that the text matches."""
    chain = None
    for pattern, label in rules:
        chain = F.when(text.rlike(pattern), label) if chain is None else chain.when(text.rlike(pattern), label)
    return chain.otherwise(default)


def _any_of(words: list[str]) -> str:
    return "|".join(words)


def is_rizin_mma(event: Column) -> Column:
    e = F.coalesce(event, F.lit(""))
    return e.rlike("(?i)RIZIN") & ~e.rlike(NON_MMA_EVENT)


def is_mma_rules(event: Column) -> Column:
    return ~F.coalesce(event, F.lit("")).rlike(NON_MMA_EVENT)


def weigh_in_missed(method: Column, event: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(method, F.lit("")), F.coalesce(event, F.lit(""))).rlike(WEIGH_IN_MISS)


def method_class(method: Column) -> Column:
    """finish, decision or unknown: what names no decision is a finish."""
    m = F.trim(F.coalesce(method, F.lit("")))
    return F.when(m == "", "unknown").when(m.contains("判定"), "decision").otherwise("finish")


def is_unknown_method(method: Column) -> Column:
    m = F.trim(method)
    return (m == "") | (m == "—") | F.trim(F.regexp_replace(m, r"^\S*\s+[\d:]+\s+", "")).rlike("(?i)^N/A$")


def method_kind(method: Column) -> Column:
    """ko, sub, decision or other; a leading SUB comes before all else."""
    return first_match(method, [("(?i)^SUB", "sub"), ("判定", "decision"), ("(?i)TKO|KO", "ko"), (SUBMISSION_JA, "sub")], "other")


def method_from_results(method: Column) -> Column:
    """ko, sub or decision, null for anything else."""
    return first_match(method, [("判定", "decision"), ("KO|TKO", "ko"), (SUBMISSION_RESULT, "sub")])


def method_leftover(method: Column) -> Column:
    """What is neither a decision nor a knockout counts as a submission."""
    return F.when(method.contains("判定"), "decision").when(method.rlike("(?i)KO"), "ko").otherwise("sub")


def method_en(method: Column) -> Column:
    """English record tables: submission, then knockout, then decision."""
    return first_match(F.lower(method), [("submission", "sub"), (r"\bt?ko\b|knockout", "ko"), ("decision", "decision")], "other")


def result_en(result: Column) -> Column:
    return first_match(F.lower(F.trim(result)), [("^win", "win"), ("^loss", "loss"), ("^draw", "draw"), ("^nc|no contest", "nc"), ("cancel", "cancelled")], "unknown")


def non_pro(*columns: Column) -> Column:
    text = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in columns))
    rules = [(_any_of(words), label) for label, words in NON_PRO.items()]
    return F.when(text.rlike(EXEMPT_TOURNAMENT), F.lit(None).cast("string")).otherwise(first_match(text, rules))


def rule_type(heading: Column, division: Column) -> Column:
    text = F.concat_ws(" ", F.nullif(heading, F.lit("")), F.nullif(division, F.lit("")))
    return F.when(F.trim(text) == "", "unknown").when(text.rlike("MMA"), "MMA").otherwise(first_match(text, RULE_TYPES, "MMA"))


def news_type(title: Column) -> Column:
    return first_match(F.coalesce(title, F.lit("")), [(_any_of(w), k) for k, w in NEWS_TYPES.items()], "article")


def article_kind(source: Column) -> Column:
    return F.when(source.isin(OFFICIAL_SOURCES), "official").otherwise("media")


def is_flash(kind: Column, type_: Column, detected: Column, override: Column, now: Column) -> Column:
    """Official news of certain types for a day; an override wins either way."""
    o = F.coalesce(override, F.lit("none"))
    fresh = F.coalesce(detected > now - F.expr("INTERVAL 24 HOURS"), F.lit(False))
    return F.when(o == "suppress", False).when(o == "force", True).otherwise((kind == "official") & type_.isin(FLASH_TYPES) & fresh)


def division_by_kg(kg: Column) -> Column:
    """A step function with a gap between 71.5 and 93 kg."""
    return F.when(kg <= 57.5, "フライ級").when(kg <= 61.5, "バンタム級").when(kg <= 66.5, "フェザー級").when(kg <= 71.5, "ライト級").when(kg >= 93.0, "ヘビー級")


def division(weight_class: Column) -> Column:
    w = F.coalesce(weight_class, F.lit(""))
    none = F.lit(None).cast("string")
    return (
        F.when(w.rlike("(?i)女子|アトム|JEWELS"), none)
        .when(w.rlike("ウェルター|ミドル|ライトヘビー"), none)
        .when(w.rlike("ヘビー級|メガトン|スーパーヘビー"), "ヘビー級")
        .when(w.rlike("ストロー級|フライ級"), "フライ級")
        .when(w.rlike("バンタム級"), "バンタム級")
        .when(w.rlike("フェザー級"), "フェザー級")
        .when(w.rlike("ライト級"), "ライト級")
        .otherwise(division_by_kg(F.nullif(F.regexp_extract(w, r"(\d+(?:\.\d+)?)\s*kg", 1), F.lit("")).cast("double")))
    )


def earliest_label(text: Column, labels: dict[str, str]) -> Column:
    """The label whose pattern starts first in the text, ties by label; null where none does."""
    hits = F.filter(F.array(*(F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(label).alias("label")) for label, p in labels.items())), lambda x: x["at"] > 0)
    return F.array_min(hits)["label"]


def nearest_limit(kg: Column, limits: dict[str, float]) -> Column:
    """The label of the nearest limit; of two as near the one listed first."""
    options = F.array(*(F.struct(F.abs(kg - v).alias("far"), F.lit(i).alias("i"), F.lit(k).alias("label")) for i, (k, v) in enumerate(limits.items())))
    return F.when(kg.isNotNull(), F.array_min(options)["label"])


def result_after_ruling(result: Column, missed_by: Column) -> Column:
    """A win by the side that missed weight is a no contest."""
    return F.when((missed_by == "opponent") & (result == "loss"), "nc").when((missed_by == "self") & (result == "win"), "nc").otherwise(result)


def is_mma(title: Column) -> Column:
    return title.rlike("|".join(MMA_WORDS))


def promotion(event: Column) -> Column:
    """The promotion that an event's name shows; of those without records of their own, one label for the unknown."""
    e = F.coalesce(event, F.lit(""))
    return first_match(e, PROMOTIONS + FURTHER_PROMOTIONS, OTHER_PROMOTION)


def five_class(weight_class: Column) -> Column:
    return first_match(weight_class, FIVE_CLASSES)


def class_order(weight_class: Column) -> Column:
    """A sort key: limits in kg, women's classes behind men's, unknown ones last."""
    pairs = [*CLASS_KG.items(), *((k, 1000 + v) for k, v in WOMEN_KG.items())]
    return F.coalesce(F.create_map(*(F.lit(x) for pair in pairs for x in pair))[weight_class], F.lit(9999.0))


def rank_order(rank: Column) -> Column:
    """A sort key of a rank in words: champion, interim champion, numbers, anything else."""
    number = F.nullif(F.regexp_extract(rank, r"^\s*(-?\d+)", 1), F.lit("")).cast("int")
    return F.when(rank == "王者", -2).when(rank.contains("暫定"), -1).otherwise(F.coalesce(number, F.lit(999)))


def is_kick_event(title: Column) -> Column:
    return title.rlike("(?i)KICK")


def is_amateur_event(title: Column) -> Column:
    return title.contains("アマチュア")


def section(text: Column, begin: str, ends: list[str]) -> Column:
    """From the opening mark to the nearest closing one, or to the end; all of it without an opening mark."""
    at = F.instr(text, begin)
    rest = F.substr(text, at)
    stops = F.array_min(F.filter(F.array(*(F.instr(rest, e) for e in ends)), lambda x: x > 0))
    return F.when(at == 0, text).when(stops.isNull(), rest).otherwise(F.substr(rest, F.lit(1), stops - 1))


def series_key(org: Column, name: Column) -> Column:
    """What tells events of one series apart where dates don't: the series and its number."""
    number = lambda p, n=1: F.regexp_extract(name, p, n)
    rules = [
        ("rizin", r"RIZIN\.(\d+)", "rizin"),
        ("rizin", r"超RIZIN\.?(\d+)", "super-rizin"),
        ("rizin", r"(?i)LANDMARK\s*(\d+)", "landmark"),
        ("shooto", r"(?i)Vol\.?\s*(\d+)", "vol"),
        ("shooto", r"(?i)Lemino\s*修斗\.?\s*(\d+)", "lemino"),
        ("pancrase", r"(?i)^(?!.*BLOOD).*?PANCRASE\s*(\d+)\b", "pancrase"),
        ("deep", r"(?i)DEEP\s*(\d+)\s*IMPACT", "deep"),
        ("deep", r"(?i)JEWELS\s*(\d+)", "jewels"),
    ]
    keys = [F.when((org == o) & (number(p) != ""), F.concat(F.lit(f"{label}."), number(p))) for o, p, label in rules]
    tokyo = r"(?i)TOKYO IMPACT\s*(\d{4})\s*(\d+)"
    return F.coalesce(*keys, F.when((org == "deep") & (number(tokyo) != ""), F.concat_ws(".", F.lit("tokyo-impact"), number(tokyo), number(tokyo, 2))))


def flash_prefix(news_type_: Column) -> Column:
    return F.when(news_type_.isin(FLASH_TYPES), "【速報】").otherwise("")


def stated_record(text: Column) -> Column:
    """A struct of total, wins, losses and draws from a profile's line such as 20戦 15勝(8KO) 4敗 1分; null without one."""
    line = r"(\d+)戦\s*(\d+)勝(?:\s*[(（][^)）]*[)）])?\s*(\d+)敗(?:\s*(\d+)分)?"
    part = lambda n: F.regexp_extract(text, line, n).try_cast("int")
    row = F.struct(part(1).alias("total"), part(2).alias("wins"), part(3).alias("losses"), F.coalesce(part(4), F.lit(0)).alias("draws"))
    return F.when(part(1).isNotNull(), row)

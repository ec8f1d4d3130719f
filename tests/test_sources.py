"""Readers, sinks, names and small operators on rows with known results."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from boutforge.functions import classify, markup, names, scores
from boutforge.operators import dedupe, overrides, reports, resolve
from boutforge.sources import feeds, sinks, versions
from boutforge.streaming import events


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_rss_and_atom(spark):
    rss = "<rss><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><pubDate>Mon, 01 Jan 2024 09:00:00 +0900</pubDate></item><item><title>C</title><link>http://x/2</link></item></rss>"
    got = feeds.rss(spark.createDataFrame([(1, rss)], "id int, xml string"), "xml").orderBy("place").collect()
    assert [(r.title, r.link) for r in got] == [("A & B", "http://x/1"), ("C", "http://x/2")]
    assert got[0].published == dt.datetime(2024, 1, 1) and got[1].published is None
    atom = '<feed><entry><title>T</title><link rel="self" href="s"/><link rel="alternate" href="a"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    row = feeds.atom(spark.createDataFrame([(1, atom)], "id int, xml string"), "xml").first()
    assert (row.title, row.link) == ("T", "a")


def test_wiki_templates(spark):
    assert feeds.balanced_blocks_of("x {{Fight|a={{b|c}}|d}} y {{Fight|e}}", "{{Fight") == ["{{Fight|a={{b|c}}|d}}", "{{Fight|e}}"]
    assert feeds.params_of("{{Fight|a={{b|c}}|[[d|e]]}}") == ["Fight", "a={{b|c}}", "[[d|e]]"]
    assert one(spark, "x {{Fight|1}}", lambda c: F.size(feeds.balanced_blocks(c, "{{Fight"))) == 1


def test_table_rows(spark):
    page = spark.createDataFrame([(1, '<table id="t"><tr><th>A</th><td class="x">B &amp; C</td></tr></table>')], "id int, html string")
    assert feeds.table_rows(page, "html").first().cells == ["A", "B & C"]


def test_missing_json_is_empty(spark, tmp_path):
    schema = StructType([StructField("a", LongType())])
    assert feeds.json_or_empty(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "x.csv").write_text("name,n\na,1\nb\n")
    assert feeds.csv_rows(spark, str(tmp_path / "x.csv"), StructType([StructField("name", StringType()), StructField("n", LongType())])).where("n is not null").count() == 1


def test_names(spark):
    same = names.roster_key
    assert one(spark, '木村"フィリップ"ミノル', same) == one(spark, "木村ミノル", same)
    assert one(spark, '田中"エース"太郎', same) != one(spark, "佐藤太郎", same)
    assert names.romaji_of("キックボクシング") == "kikkubokushingu" and names.romaji_of("しゅうと") == "shuuto" and names.romaji_of("マッチ") == "matchi"
    assert one(spark, "カトウ", names.kana_row) == "か"
    assert one(spark, "Ａｂｃ", names.nfkc) == "Abc"


def test_classifiers(spark):
    assert one(spark, "SUB（チョーク）", classify.method_kind) == "sub"
    assert one(spark, "判定 KO", classify.method_kind) == "decision"
    assert one(spark, "2R 3:00 アームバー", classify.method_kind) == "sub"
    assert one(spark, "71.6kg", classify.division) is None
    assert one(spark, "100kg契約", classify.division) == "ヘビー級"
    assert one(spark, "プロ昇格 ネオブラッド", lambda c: classify.non_pro(c)) is None
    assert one(spark, "アマチュア大会", lambda c: classify.non_pro(c)) == "not_pro_amateur"
    assert one(spark, "K-1ルール", lambda c: classify.rule_type(c, F.lit(None).cast("string"))) == "キックボクシング"
    assert one(spark, "K-1グランプリ", lambda c: classify.rule_type(c, F.lit(None).cast("string"))) == "MMA"


def test_markup_and_scores(spark):
    assert one(spark, "http://a/b?utm_source=x&c=1&fbclid=2#f", markup.without_tracking) == "http://a/b?c=1#f"
    assert one(spark, "&amp;lt;", markup.decoded) == "&lt;"
    assert one(spark, "-2.5", lambda c: scores.half_up(c.cast("double"))) == -2.0
    assert one(spark, "1300", lambda c: scores.decayed(c.cast("double"), F.lit(200))) == 1400.0
    assert one(spark, "1500", lambda c: scores.sigma_discount(c.cast("double"), F.lit(1))) == one(spark, "1500", lambda c: scores.sigma_discount(c.cast("double"), F.lit(2)))


def test_near_names_match_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    words = ["tanaka", "tanka", "tanakka", "sato", "sate", "ito", "ita", "abc", "abcd", "", "x"]
    frame = spark.createDataFrame([(w,) for w in words], "n string")
    got = {tuple(r) for r in resolve.near_names(frame, frame).collect()}
    want = {(a, b, d) for a in words for b in words if 1 <= (d := distance(a, b)) <= 2 and not (d == 1 and min(len(a), len(b)) <= 3)}
    assert got == want


def test_near_date_merge(spark):
    rows = [("F", 1, dt.date(2020, 1, 1), "A", "Cup 5"), ("F", 2, dt.date(2020, 1, 2), "A", "Cup"), ("F", 3, dt.date(2020, 1, 2), "B", "Cup"), ("F", 4, None, "B", None)]
    got = {r.bout_id: r.merged for r in dedupe.near_date_merge(spark.createDataFrame(rows, "fighter string, bout_id long, date date, opponent string, event string")).collect()}
    assert got == {1: [2], 3: [4]}


def test_constrained_union(spark):
    rows = [("n", "1", "s1", "g"), ("n", "2", "s1", "g"), ("n", "3", "s2", "g"), ("n", "4", "s3", "h")]
    got = dict(tuple(r) for r in dedupe.constrained_union(spark.createDataFrame(rows, "name string, key string, source string, gym string"), "name").collect())
    assert got == {"1": "1", "2": "2", "3": "1", "4": "4"}


def test_agreeing_resolution_and_denial(spark):
    rows = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", None, "z"), ("d", "q", None)], "k string, direct string, stripped string")
    denied = spark.createDataFrame([("d",)], "k string")
    got = dict(tuple(r) for r in resolve.agreeing(rows, "direct", "stripped", denied, ["k"], "out").select("k", "out").collect())
    assert got == {"a": "x", "b": None, "c": "z", "d": None}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(k, k * 2) for k in range(10)], "k long, v long")
    assert sinks.promote(rows, str(tmp_path / "p")) and not sinks.promote(rows.limit(5), str(tmp_path / "p")) and sinks.promote(rows.limit(6), str(tmp_path / "p"))
    assert [r.n for r in versions.Versions(spark, str(tmp_path / "p")).history()] == [10, 6]
    assert sinks.stamp(rows) == sinks.stamp(rows.orderBy(F.desc("k"))) != sinks.stamp(rows.limit(9))
    sinks.serve_by_key(rows, "k", str(tmp_path / "s"), 4)
    assert sinks.served(spark, str(tmp_path / "s"), "k", 7, 4).first().v == 14
    sinks.write_snapshot(rows, str(tmp_path / "w"), "2024-01-01", True)
    sinks.write_snapshot(rows.limit(3), str(tmp_path / "w"), "2024-01-02", False)
    kept = versions.Versions(spark, str(tmp_path / "w"))
    assert kept.read().count() == 3 and kept.read(day="2024-01-05").count() == 10 and kept.read(day="2023-12-31") is None


def test_late_rows_are_set_apart(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2030, 1, 1)), (3, None)], "id int, ts timestamp")
    good, bad = events.split_late(rows, "ts", F.lit(dt.datetime(2024, 6, 1)))
    assert [r.id for r in good.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3}


def test_rows_are_posted_once(spark, tmp_path):
    log, sent = str(tmp_path / "posted"), str(tmp_path / "sent")
    (tmp_path / "sent").mkdir()

    def send(row):
        (tmp_path / "sent" / row.key).open("a").write("x")

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    assert reports.post_once(rows, log, "key", send) == 2
    assert reports.post_once(rows.union(spark.createDataFrame([("c",)], "key string")), log, "key", send) == 1
    assert reports.post_once(rows, log, "key", send) == 0
    assert {p.name: p.read_text() for p in (tmp_path / "sent").iterdir()} == {"a": "x", "b": "x", "c": "x"} and sent


def test_added_rows_take_later_patches_only(spark):
    history = [("f", "2020-01-01", "x", "win", "KO", "e", "1", None)]
    patches = [
        ("f", 1, "remove", "2020-01-01", "x", None, None, None, None, None, None),
        ("f", 2, "add", "2020-01-01", "x", "loss", "判定", "e2", "3", None, None),
        ("f", 3, "patch-date", "2020-01-01", "x", None, None, None, None, None, "2020-01-02"),
        ("f", 4, "add", "2020-01-02", "x", "draw", "", "", "", None, None),
        ("g", 5, "add", "2021-01-01", "y", "win", "TKO", "e3", "2", None, None),
    ]
    columns = "fighter string, date string, opponent string, result string, method string, event string, round string, weight_class string"
    got = overrides.patched(spark.createDataFrame(history, columns), spark.createDataFrame(patches, columns.replace("date string, opponent", "ord int, type string, date string, opponent") + ", new_date string"))
    assert {(r.fighter, r.date, r.opponent, r.result) for r in got.collect()} == {("f", "2020-01-02", "x", "loss"), ("g", "2021-01-01", "y", "win")}

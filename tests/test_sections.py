"""Blocks of tag soup, layouts of bouts and loose paragraphs on small pages."""

from boutforge.sources import sections

SOUP = """<html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><h1>no</h1>";</script></head><body>
loose <h1>One</h1><p>a <b>bold</b><p class=x>b<br>c<!-- <p>no</p> --> d</div><h2>Two</h2><ul><li>i<li>j <a href=q>k</a></ul>tail<h4>deep</h4><h3>Three</h3><table><tr><td>1<td>2</table><h1>Four</h1>end"""


def page(spark, html):
    return sections.blocks(spark.createDataFrame([(7, html), (8, None), (9, "")], "page int, html string"), "page", "html")


def test_blocks_of_tag_soup(spark):
    rows = [(r.tag, r.opens, r.path, r.headings, r.text) for r in page(spark, SOUP).orderBy("n").collect()]
    assert rows == [
        ("title", True, "html/head/title", [], "T & x"),
        ("body", True, "html/body", [], "loose"),
        ("h1", True, "html/body/h1", [], "One"),
        ("p", True, "html/body/p", ["One"], "a bold"),
        ("p", True, "html/body/p", ["One"], "b\nc d"),
        ("h2", True, "html/body/h2", ["One"], "Two"),
        ("li", True, "html/body/ul/li", ["One", "Two"], "i"),
        ("li", True, "html/body/ul/li", ["One", "Two"], "j k"),
        ("body", False, "html/body", ["One", "Two"], "tail"),
        ("h4", True, "html/body/h4", ["One", "Two"], "deep"),
        ("h3", True, "html/body/h3", ["One", "Two", "deep"], "Three"),
        ("td", True, "html/body/table/tr/td", ["One", "Two", "Three"], "1"),
        ("td", True, "html/body/table/tr/td", ["One", "Two", "Three"], "2"),
        ("h1", True, "html/body/h1", ["One", "Two", "Three"], "Four"),
        ("body", False, "html/body", ["Four"], "end"),
    ]


def test_very_long_and_broken_pages(spark):
    long = "<p>" + "word " * 200_000 + "<p>" * 50_000 + "x" + "</div>" * 50_000 + "<p"
    rows = page(spark, long).collect()
    assert [len(r.text) for r in rows] == [999_999, 1, 2]


BOUTS = """<p style="text-align:center; font-weight: bold">(Win)早い(KO)者(Lose)</p>
<h2 class="article-heading">第1試合</h2><div class="raw-html"><div>video</div><p style="text-align:center;"><span style="font-weight: bold;">企画</span></p><p style="text-align:center;">RIZIN 66kg<br><span style="font-weight: bold;">（WIN）<a href="1">甲</a> vs. <a href="2">乙</a>（LOSE）</span><br>1R 2:03<br>KO</p></div>
<h2 class="article-heading">第2試合</h2><p>［70kg］</p><h3 class="article-subheading">［Win］ 丙 （ 判定3-0 ） 丁 ［Lose］</h3>
<h2 class="article-heading">休憩</h2><p>nothing here</p>
<h2 class="article-heading">第3試合</h2><h3 class="article-subheading">前座A</h3><p style="text-align:center; font-weight: bold">戊<br> (時間切れ) <br>己</p><h3 class="article-subheading">前座B</h3><p style="text-align:center; font-weight: bold">(Lose)<a>庚</a> vs. <a>辛</a>(Win)<br>2R 一本</p>
<p class="wp-block-paragraph">○ 乙（gym）vs ×甲（gym） KO</p><p class="wp-block-paragraph">○壬（g）×癸（h） 一本</p><p class="wp-block-paragraph">×癸（h）○壬（g） 一本</p><p class="wp-block-paragraph">子（a）対 丑（b） いつか</p><p class="wp-block-paragraph">子（a）対 寅（b） 判定</p><p class="wp-block-paragraph">○ 判定（a）対 ×卯（b）</p>"""


def test_layouts_in_order_and_recovery(spark):
    rows = page(spark, BOUTS)
    found = sections.bouts(rows, "page")
    got = {(r.heading, r.layout, r.rule, r.a, r.b, r.mark_a, r.mark_b, r.method) for r in found.collect()}
    assert got == {
        ("第1試合", "a", "RIZIN 66kg", "甲", "乙", "WIN", "LOSE", "1R 2:03 KO"),
        ("第2試合", "b", "70kg", "丙", "丁", "WIN", "LOSE", "判定3-0"),
        ("前座A", "d", "", "戊", "己", None, None, "時間切れ"),
        ("前座B", "c", "", "庚", "辛", "LOSE", "WIN", "2R 一本"),
    }
    more = {(r.a, r.b, r.mark_a, r.mark_b, r.method) for r in sections.recovered(rows, found, "page").collect()}
    assert more == {("壬", "癸", "○", "×", "一本"), ("子", "寅", "", "", "判定")}


def test_a_page_without_headings_is_one_section(spark):
    html = '<div><p style="text-align:center; font-weight: bold">(Win)甲(KO)乙(Lose)</p></div>'
    r = sections.bouts(page(spark, html), "page").first()
    assert (r.layout, r.heading, r.a, r.b, r.mark_a, r.mark_b, r.method) == ("d", "", "甲", "乙", "WIN", "LOSE", "KO")


def test_calendar_lines(spark):
    html = "<ul><li>2024年5月6日（月・祝） 大会A ＠ 会場B<li>2024.12.3 大会C<li>2024/13/3 x<li>no date<li>2024-2-9(土)D @E</ul>"
    got = [(str(r.date), r.title, r.venue) for r in sections.calendar(page(spark, html), "page").orderBy("n").collect()]
    assert got == [("2024-05-06", "大会A", "会場B"), ("2024-12-03", "大会C", None), ("2024-02-09", "D", "E")]


def test_whole_pages_give_what_blocks_give(spark):
    import random

    rng = random.Random(24)
    some = lambda *x: rng.choice(x)
    name = lambda: some("甲", "乙", "丙 ", " A-1", "", "é", "判定", "第1試合", "D.D", "x\u2028y", "丁")
    mark = lambda: some("Win", "LOSE", "Draw", "-", "", "Ⅷ")
    brackets = lambda x: some("(%s)", "（%s）", "［%s］", "[%s]", "%s") % x
    link = lambda x: some("<a href='q'>%s</a>", "<a><b>%s</b></a>", "%s") % x
    centre = lambda: some('<p style="text-align:center">', '<p style="FONT-WEIGHT:  bold">', "<p>", '<p class="wp-block-paragraph">')

    def part():
        kind = rng.randrange(8)
        if kind < 2:
            return some('<h2 class="article-heading">', "<h3 class=article-subheading>", '<h3 class="article-subheading">', "<h2>") + some("第2試合", "", "[x]", "後半<br>y") + some("</h2>", "</h3>", "")
        if kind == 2:
            return '<h3 class="article-subheading">' + f"[{mark()}] {name()} （ {some('KO', 'a）b', '')} ） {name()} [{mark()}]</h3>"
        if kind == 3:
            return centre() + f"{some('', '70kg<br>')}<b>{brackets(mark())}{link(name())} vs. {link(name())}{brackets(mark())}</b><br>{some('1R', ' KO  &amp;', '')}{some('', '<b>z</b>', '<a>w</a>')}</p>"
        if kind == 4:
            return centre() + f"({mark()}){name()}<br> ({some('判定', '')}) <br>{name()}({mark()}){some('', 'x')}</p>"
        if kind == 5:
            return centre() + brackets(some("70kg", "", "女子")) + some("</p>", "<!-- <p>［q］</p> -->", "<script>var a='<p>'</script></p>")
        if kind == 6:
            return '<p class="wp-block-paragraph">' + f"{some('○', '×', '')} {name()}（{some('ジム', 'x' * 41)}） {some('vs', '対', '')} {some('○', '×', '')}{name()}（<b>g</b>） {some('一本', '判定', 'いつか', '')}{some('', 'z' * 200)}</p>"
        return some("text", "</div>", "<div>", "<footer>", "&nbsp;", "<ul><li>i", "<HR/>", "<b>")

    htmls = [(k, "".join(part() for _ in range(rng.randrange(14)))) for k in range(1500)] + [(-1, None), (-2, BOUTS), (-3, SOUP)]
    pages = spark.createDataFrame(htmls, "page int, html string")
    rows = sections.blocks(pages, "page", "html")
    rows = rows.persist()
    found = sections.bouts(rows, "page")
    shown = lambda frame: sorted(map(repr, map(tuple, frame.select(*columns).collect())))
    columns = found.columns
    want = shown(found)
    assert shown(sections.page_bouts(pages, "page", "html")) == want
    assert {k for k in "abcd" if any(f"'{k}'" in r for r in want)} == set("abcd") and len(want) > 400
    more = sections.recovered(rows, found, "page")
    columns = more.columns
    assert shown(sections.page_recovered(pages, "page", "html")) == shown(more) != []


def test_result_pages_are_read_where_they_are_cut(spark):
    from boutforge.plans import registry

    for name in ("result_page_bouts", "recovered_bouts"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "format_string" not in plan
        assert "Exchange" not in plan.split("MapInArrow")[0]

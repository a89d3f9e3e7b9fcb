from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlake.functions import html
from adlake.operators import page_records, pages

D = date


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page_id int, html string")


def parse(spark, body, tags):
    row = html.parse_elements(frame(spark, body), tags, ["page_id"]).first()
    return row.elements


def texts(spark, body, tags):
    parsed = html.parse_elements(frame(spark, body), tags, ["page_id"])
    return parsed.select(F.transform("elements", pages.raw_text)).first()[0]


UNCLOSED = "<ul><li>a<li>b<ul><li>c</ul></li></ul><p>x<p>y<img src=i>z"


def test_unclosed_and_nested_elements(spark):
    found = parse(spark, UNCLOSED, ["ul", "li", "p", "img"])
    assert [(e.tag, e.parent, e.last, t) for e, t in zip(found, texts(spark, UNCLOSED, ["ul", "li", "p", "img"]))] == [
        ("ul", None, 4, "abc"), ("li", 0, 1, "a"), ("li", 0, 4, "bc"), ("ul", 2, 4, "c"), ("li", 3, 4, "c"),
        ("p", None, 5, "x"), ("p", None, 7, "yz"), ("img", 6, 7, "")]


def test_class_filter_entities_and_scripts(spark):
    body = "<div class='a b'>1 &amp; 2</div><div class='c'>3</div><script>'<div class=a>'</script>"
    found = parse(spark, body, {"div": ["a"]})
    assert [(e.attrs["class"], e.classes) for e in found] == [("a b", ["a", "b"])]
    assert texts(spark, body, {"div": ["a"]}) == ["1 & 2"]


PIECES = st.lists(st.sampled_from([
    "<p>", "</p>", "<div class='a b'>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<br/>", "<img src=x>", "text ",
    "&amp", "&#0;", "&#xffffff;", "<!--", "-->", "<![", "<![foo[", "]]>", "<!", "<!DOCTYPE", "<?x", ">", "<", "</", "<a href='",
    "'", '"', "<script>", "</script>", "<title>", "</title>", "<style>", "\x00", "é", "<p a=1 a=2 b>", "</ p>", "<1>"]), max_size=25)


@settings(max_examples=400, deadline=None)
@given(pieces=PIECES)
def test_any_text_can_be_parsed(pieces):
    page = "".join(pieces)
    wanted = {"p": None, "div": frozenset(["a"]), "li": None, "td": None, "img": None, "title": None}
    parsed = html._Elements(wanted).parsed(page)
    found = parsed["elements"]
    for i, e in enumerate(found):
        assert e["pos"] == i <= e["last"] < len(found)
        if e["parent"] is not None:
            outer = found[e["parent"]]
            assert outer["pos"] < i and e["last"] <= outer["last"] and outer["start"] <= e["start"] <= e["end"] <= outer["end"] <= len(parsed["page_text"])
    assert isinstance(html._PlainText().text(page), str)


def test_deep_page_is_parsed_in_good_time(spark):
    body = "<b>x</i>" * 50_000 + "<p>end</p>"
    assert texts(spark, body, ["p"]) == ["end"]


def test_nested_elements_repeat_no_text():
    sizes = []
    for n in (1000, 4000):
        parsed = html._Elements({"div": None}).parsed("<div class='row'>some text" * n)
        assert len(parsed["elements"]) == n and parsed["elements"][0]["end"] == 9 * n
        sizes.append(len(str(parsed)))
    assert sizes[1] < 5 * sizes[0]


def test_unclosed_links_do_not_nest(spark):
    assert texts(spark, "<a href=1>one<a href=2>two<a href=3>three", ["a"]) == ["one", "two", "three"]


def test_null_page_gives_null(spark):
    assert parse(spark, None, ["p"]) is None
    assert html.plain_text(frame(spark, None)).first().text is None


def test_plain_text(spark):
    body = ("<html><title>T</title><style>p{}</style><body><p>one\n two <a href='/x'>link</a><br>three"
            "<!-- no --><script>bad()</script><li>&eacute;</body>")
    assert html.plain_text(frame(spark, body)).first().text == "T\none two link\nthree\né"


def test_long_page_is_read_to_the_end(spark):
    body = "<p>" + "x" * 2_000_000 + "</p><p>end</p>"
    assert texts(spark, body, ["p"])[1] == "end"


def test_listing_rows_only_in_cards(spark):
    parsed = html.parse_elements(frame(
        spark, "<a href='/0'>out</a><li class='featured x'><a href='/7?q=1'> In </a></li>"), ["li", "a"], ["page_id"])
    assert [tuple(r) for r in pages.listing_rows(parsed).collect()] == [(0, 2, "In", "/7", "7", 1)]


def test_category_links_need_a_word(spark):
    parsed = html.parse_elements(frame(
        spark, "<a href='/a'><img src='i.png'>Jobs</a><a href='/b'> - </a><a href='/c'>عمل</a>"), ["a", "img"], ["page_id"])
    assert [(r.label, r.img) for r in pages.category_links(parsed).collect()] == [("Jobs", "i.png"), ("عمل", "")]


def test_summary_card_without_date_has_none(spark):
    card = "<div id='{0}' data-id='u{0}'><a href='/{0}'>t</a><div class='meta-desc'>{1}</div><p>d</p></div>"
    body = "<div id='jobs_list'>" + card.format(1, "4 March 2018") + card.format(2, "none") + "</div>"
    got = page_records.summary_cards(frame(spark, body), ["page_id"]).collect()
    assert [(r.uniqueid, r.postdate, r.company) for r in got] == [("u1", D(2018, 3, 4), None), ("u2", None, None)]


def test_page_without_list_gives_no_cards(spark):
    empty = frame(spark, "<p>nothing</p>", None)
    assert page_records.summary_cards(empty, ["page_id"]).count() == 0
    assert page_records.classified_cards(empty, ["page_id"], D(2020, 1, 1)).count() == 0
    assert page_records.board_cards(empty, ["page_id"]).count() == 0
    assert page_records.region_counts(empty, ["page_id"]).count() == 0


def test_classified_page_states(spark):
    live = ("<span class='pdingleft10 brlefte5'>at 14:05, 3 March 2018, Ad ID: 42</span><div id='textContent' class='clr'>"
            "a\r\nb</div><div class='pricelabel'>1,000 - 2,000</div>")
    got = page_records.classified_page(frame(spark, None, "<p>", live), ["page_id"]).orderBy("page_id").collect()
    assert [r.stat for r in got] == ["NOT FOUND", "CLOSED", "OPEN"]
    assert (got[2].adid, got[2].postdate, got[2].posttime) == (42, D(2018, 3, 3), "14:05")
    assert (got[2].description, got[2].compensation, got[2].title) == ("a >b", 1000, None)
    assert (got[2].emailavail, got[1].emailavail) == (0, None)


def test_board_page_defaults(spark):
    main = "<div class='job-main-card'><h1 class='job-title'>Cook</h1></div>"
    closed = "<div class='alert alert-danger alert-job'>x</div>" + main
    got = page_records.board_page(frame(spark, None, main, closed, "<p>"), ["page_id"]).orderBy("page_id").collect()
    assert [r.stat for r in got] == ["NOT FOUND", "OPEN", "CLOSED", "OPEN"]
    assert (got[1].num_applicants, got[1].num_vacancies, got[1].num_seen, got[1].jobtitle) == (0, 1, 0, "Cook")
    assert got[3].num_applicants is None and got[1].requirements == ""


def test_ad_details_and_dead_pages(spark):
    table = ("<table class='table job-details-table'><tr><th>Location</th><td>\tCairo</td></tr>"
             "<tr><th>Salary</th><td>1</td></tr><tr><th>Salary</th><td>2</td></tr></table>")
    dead = "<div class='alert alert-warning'>gone</div>"
    both = frame(spark, table, dead, "<p>")
    got = page_records.ad_details(both, ["page_id"]).collect()
    assert [(r.page_id, r.location, r.salary, r.postdate, r.pubimg) for r in got] == [(0, "Cairo", "2", None, None)]
    assert [r.page_id for r in page_records.dead_pages(both, ["page_id"]).collect()] == [1]


RESUME = """<title>Omar | site</title><div class='media-left biothumb'><img src='x/img/avatar.png'></div>
<div class='media profile-header'><h4 class='no-margin'>Cairo</h4><h4>Cook</h4><p>Working</p></div>
<div class='section-block'><div class='panel-header listing-header'><h2>Experiences</h2></div><div class='row'>
<li style='position:relative;'><div class='date'>Mar&nbsp;2015 - May 2016</div><div class='subject'>Cook</div>
<p>Inn | Town</p></li><li style='position:relative;'><div class='date'>2011</div><div class='subject'>Boy</div>
<p>same</p><div class='col-md-10'> same </div></li></div></div>"""


def test_resume_page(spark):
    got = page_records.resume_page(frame(spark, RESUME, "<title>x</title>"), ["page_id"], D(2020, 1, 1))
    full, gone = got.orderBy("page_id").collect()
    assert gone.error == "profile is deactivated" and full.error is None
    assert (full.name, full.has_photo, full.location, full.title, full.jobstatus) == ("Omar", 0, "Cairo", "Cook", "Working")
    first, second = full.experiences
    assert (first.jobtitle, first.company, first.location, first.date.end) == ("Cook", "Inn", "Town", D(2016, 5, 1))
    assert (second.date.year, second.company, second.description) == (2011, None, "same")
    assert full.last_active is None and not full.skills


@pytest.mark.parametrize("n", [1, 450])
def test_many_pages(spark, n):
    df = spark.range(n).select("id", F.format_string("<p>%d</p>", "id").alias("html"))
    got = html.parse_elements(df, ["p"], ["id"]).select("id", pages.raw_text(F.col("elements")[0]).cast("long").alias("t"))
    assert got.filter("id <> t").count() == 0 and got.count() == n


ODD = ["", "<div", "</div></p>", "<div class='row'>" * 300 + "x", "<table class='job-details-table'><tr><th>Salary<tr><td>1<th>Company<td>",
       "<div id='jobs_list'><div id='job-x' data-id><a><p></div>", "<div class='section-block'><div><h2>Education<div class='row'><li style><p>|||</li>",
       "<div class='media profile-header'><p>", "<span class='brlefte5 block'>Ad ID: <div class='clr'><h1>", "<time title><a href>", None]


@pytest.mark.parametrize("kind", ["classified_cards", "summary_cards", "board_cards", "resume_cards", "region_counts", "sector_counts",
                                  "classified_page", "board_page", "ad_details", "dead_pages", "resume_page"])
def test_odd_markup_gives_rows_or_none(spark, kind):
    pages_ = frame(spark, *ODD)
    dated = {"classified_cards", "resume_page"}
    made = getattr(page_records, kind)(pages_, ["page_id"], *([D(2020, 1, 1)] if kind in dated else []))
    rows = made.collect()
    assert {r.page_id for r in rows} <= set(range(len(ODD)))
    if kind.endswith("_page"):
        assert len(rows) == len(ODD)

"""Pages of plain markup are read by tokens, as the standard parser would; cards are parsed once."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from adlake import runs
from adlake.functions import html
from adlake.sources.schemas import SCHEMAS

WANTED = dict.fromkeys(["html", "a", "li", "p", "div", "title", "img", "td", "tr", "ul", "script"])
PLAIN = ["<!DOCTYPE html>", "<div>", "</div>", "<li class='a b'>", "<li CLASS=\"x\">", "</LI>", "<a href='/x?a=1&amp;b=2'>",
         "<a href=\"?a&copy=1&lang=2\">", "</a >", "<br/>", "<img src='a>b' />", "<p\n id='q'\t>", "</p>", "a & b", "&lt", "&#65;&copyx",
         "<!-- c -->", "<title>t &amp; u</title>", "<script>a &amp; b</script>", "<style>x>y</style>", "<a b b='2'/>", "é\x00&am", "<tr><td>"]
OTHER = ["<", "<<b>", "<!-- a-b -->", "<!-->", "<![CDATA[x]]>", "<?php a?>", "<title>", "<script>if(a<b){}</script>", "<textarea>", "</ div>",
         "<div a=b>", "<div a = 'b'>", "<p\xa0x>", "<a b='c'd='e'>", "<x-y>", "<b", "</"]


def standard(parser):
    def read(page):
        parser.feed(page)
        parser.close()

    parser.read = read
    return parser


@pytest.mark.parametrize("parts", [PLAIN, PLAIN + OTHER])
def test_tokens_give_what_the_standard_parser_gives(parts):
    draw, known = random.Random(7), {}
    for _ in range(3000):
        page = "".join(draw.choices(parts, k=draw.randint(1, 12)))
        assert html._Elements(WANTED, known).parsed(page) == standard(html._Elements(WANTED)).parsed(page), page
        assert html._PlainText(known).text(page) == standard(html._PlainText()).text(page), page


def test_plain_pages_do_without_the_standard_parser(monkeypatch):
    def refuse(self, page):
        raise AssertionError(page)

    monkeypatch.setattr(html._Elements, "feed", refuse)
    page = "<!DOCTYPE html><html><title>T</title><div class='a'>x &amp; <b>y</b><br/><a href=\"/u\">l</a><!-- c --></div></html>"
    found = html._Elements(dict.fromkeys(["div", "a"])).parsed(page)
    assert found["page_text"] == "x & yl" and [e["attrs"] for e in found["elements"]] == [[("class", "a")], [("href", "/u")]]


def test_cards_are_parsed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def parse(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def table(name):
        return spark.createDataFrame([], SCHEMAS[name])

    pages = spark.range(40).select(F.lit("x").alias("country"), F.lit("c").alias("cat"), F.lit("s").alias("subcat"),
                                   F.when(F.col("id") > 3, F.concat(F.lit("u"), "id")).alias("uniqueid"))
    parsed = pages.mapInArrow(parse, pages.schema)
    lacking = [f for f in SCHEMAS["ad_summary"].fields if f.name not in parsed.columns]
    cards = parsed.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking})
    links = table("category_links").unionByName(spark.createDataFrame(
        [("x", date(2020, 1, 1))], "country string, downloaddate date"), allowMissingColumns=True)
    made = runs.load_summaries(links, cards, table("category_links"), table("ad_summary"), f"{tmp_path}/out")
    assert made["summary"].count() == 40 and seen.value == 40

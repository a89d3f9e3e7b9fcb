"""Pages to rows. Input: a frame with ``elements`` from ``functions.html.parse_elements``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.functions import text
from adlake.functions.text import WORD


def with_class(element: Column, names: str) -> Column:
    """The element has all the CSS classes, given as in a class attribute."""
    condition = F.lit(True)
    for name in names.split():
        condition = condition & F.array_contains(element["classes"], name)
    return condition


def attribute(element: Column, name: str) -> Column:
    return F.try_element_at(element["attrs"], F.lit(name))


def all_of(elements: Column, tag: str, classes: str | None = None, attr: str | None = None) -> Column:
    """The elements of a tag, with some classes or an attribute."""
    def matches(e: Column) -> Column:
        condition = e["tag"] == tag
        if classes:
            condition = condition & with_class(e, classes)
        if attr:
            condition = condition & attribute(e, attr).isNotNull()
        return condition

    return F.filter(elements, matches)


def first_of(elements: Column, tag: str, classes: str | None = None, attr: str | None = None) -> Column:
    """First such element, null if there is none."""
    return F.get(all_of(elements, tag, classes, attr), 0)


def inside(elements: Column, element: Column) -> Column:
    """The elements inside an element; null if there is no such element."""
    return text.let(element, lambda e: F.slice(elements, e["pos"] + 2, e["last"] - e["pos"]))


def raw_text(element: Column) -> Column:
    """The text inside an element, taken from the columns ``page_text`` and ``text_base``."""
    return text.let(element, lambda e: F.substr(
        F.col("page_text"), e["start"] - F.col("text_base") + 1, e["end"] - e["start"]))


def text_of(element: Column) -> Column:
    return text.strip(raw_text(element))


def own_text(element: Column) -> list[Column]:
    """``page_text`` and ``text_base`` cut down to one element, for a row of its own."""
    return [raw_text(element).alias("page_text"), element["start"].alias("text_base")]


def count_of(elements: Column, tag: str) -> Column:
    return F.size(all_of(elements, tag))


def cards_of(parsed: DataFrame, keys: Sequence[str], cards: Column) -> DataFrame:
    """One row per card with ``card`` and the elements ``inner`` of it. The page's other
    elements are left behind before the rows are made."""
    parts = F.transform(cards, lambda c: F.struct(
        c.alias("card"), inside(F.col("elements"), c).alias("inner"), *own_text(c)))
    return parsed.select(*keys, F.explode(parts).alias("_c")).select(*keys, "_c.*")


def listing_rows(parsed: DataFrame, keys: Sequence[str] = ("page_id",), card: str = "li",
                 id_pattern: str = r"(\d+)", featured_class: str = "featured") -> DataFrame:
    """One row per link in an ad card: title, link, ad id in the link, featured flag."""
    outer = F.transform(all_of(F.col("elements"), "a"), lambda a: F.struct(
        a.alias("a"), F.get("elements", a["parent"]).alias("card"), text_of(a).alias("title")))
    rows = parsed.select(*keys, F.explode(outer).alias("_r")).select(*keys, "_r.*")
    href = attribute(F.col("a"), "href")
    return rows.filter(F.col("card.tag") == card).select(
        *keys, F.col("a.pos").alias("pos"), "title",
        F.get(F.split(href, r"\?"), 0).alias("href"),
        text.capture(href, id_pattern).alias("uid"),
        with_class(F.col("card"), featured_class).cast("int").alias("i_featured"))


def category_links(parsed: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Links whose text starts with a word, with the source of an image inside, or ''."""
    rows = cards_of(parsed, keys, all_of(F.col("elements"), "a"))
    link = F.col("card")
    image = attribute(first_of(F.col("inner"), "img"), "src")
    return rows.select(*keys, F.col("card.pos").alias("pos"), text_of(link).alias("label"),
                       attribute(link, "href").alias("href"),
                       F.coalesce(image, F.lit("")).alias("img")).filter(
        F.col("label").rlike(f"^[{WORD}]"))


def detail_cells(elements: Column) -> Column:
    """Header and data cells of table rows as array<struct<key,value>>.

    A row's th and td follow each other in the parsed order, so a th is paired with the
    td after it.
    """
    cells = F.filter(elements, lambda e: e["tag"].isin("th", "td"))

    def pair(all_cells: Column) -> Column:
        n = F.greatest(F.size(all_cells) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(all_cells, 1, n), F.slice(all_cells, 2, n), lambda h, d: F.struct(
            F.when((h["tag"] == "th") & (d["tag"] == "td"), text_of(h)).alias("key"),
            text_of(d).alias("value")))
        return F.filter(pairs, lambda p: p["key"].isNotNull())

    return text.let(cells, pair)


def page_record(parsed: DataFrame, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Language, titles and number of paragraphs, items and links of a page."""
    elements = F.col("elements")
    return parsed.select(
        *keys, attribute(first_of(elements, "html"), "lang").alias("lang"),
        text_of(first_of(elements, "title")).alias("title"),
        text_of(first_of(elements, "h1")).alias("h1"),
        count_of(elements, "p").alias("paragraphs"), count_of(elements, "li").alias("list_items"),
        count_of(elements, "a").alias("links"))


def segment_counts(df: DataFrame, keys: Sequence[str], region: str, sectors: str) -> DataFrame:
    """Site map lines to count rows: 'Region (n)' with an array of 'Sector (n)' labels."""
    name, total = text.count_label(F.col(region))
    rows = df.select(*keys, name.alias("region"), text.slug(name).alias("freg"),
                     total.alias("totalregposts"), F.explode(sectors).alias("_label"))
    sub, n = text.count_label(F.col("_label"))
    return rows.select(*keys, "region", "freg", "totalregposts", sub.alias("subregion"),
                       text.slug(sub).alias("fsubreg"), n.alias("subposts"))

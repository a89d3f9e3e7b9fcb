"""Records of the known page kinds.

Each function takes pages (keys and html) and returns rows. One parser pass fetches the
elements a page kind needs; all that follows is column expressions, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions import dates, text
from adlake.functions.html import parse_elements
from adlake.operators.nested import kv_columns
from adlake.operators.pages import (
    all_of, attribute, cards_of, detail_cells, first_of, inside, own_text, raw_text, text_of, with_class,
)


def number_of(element: Column, default: int) -> Column:
    """Whole number in an element, the default where the element is missing."""
    return F.when(element.isNull(), default).otherwise(text_of(element).try_cast("int"))


def joined(elements: Column, change=text_of) -> Column:
    return text.join_list(F.transform(elements, change))


def classes_of(markup: dict[str, str], *names: str) -> list[str]:
    """First class of the named parts, enough for the parser to keep them."""
    return [markup[name].split()[0] for name in names]


def part_of(inner: Column, outer: Column, element: Column) -> Column:
    """The elements inside ``element``, taken from those inside ``outer``."""
    return F.slice(inner, element["pos"] - outer["pos"] + 1, element["last"] - element["pos"])


# Lists of ads or people


def classified_cards(pages: DataFrame, keys: Sequence[str], today: date) -> DataFrame:
    """Ad cards of a classifieds list. Cards without an observed link are old and skipped."""
    m = rules.CLASSIFIED_CARD
    parsed = parse_elements(pages, {"div": classes_of(m, "photo", "info"), "img": None, "a": None,
                                    "span": classes_of(m, "paid"), "p": classes_of(m, "date")}, keys)
    elements = F.col("elements")
    pairs = F.zip_with(
        all_of(elements, "div", m["photo"]), all_of(elements, "div", m["info"]),
        lambda photo, info: F.struct(inside(elements, photo).alias("photo"),
                                     inside(elements, info).alias("info"), *own_text(info)))
    rows = parsed.select(*keys, F.explode(pairs).alias("_c")).select(*keys, "_c.*")
    photo, info = F.col("photo"), F.col("info")
    observed = F.get(F.filter(photo, lambda e: attribute(e, "data-statkey") == m["observed"]), 0)
    image = attribute(first_of(photo, "img"), "src")
    return rows.select(
        *keys, text.capture(attribute(observed, "class"), r"\{id:(\d+)\}").cast("long").alias("uid"),
        F.get(F.split(attribute(first_of(info, "a", m["title"]), "href"), "/ad/"), 1).alias("href"),
        dates.relative_date(text_of(first_of(info, "p", m["date"])), today).alias("postdate"),
        F.when(image.contains(m["no_photo"]), 0).otherwise(1).alias("i_photo"),
        first_of(photo, "span", m["paid"]).isNotNull().cast("int").alias("i_featured"),
    ).filter(F.col("uid").isNotNull())


def summary_cards(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ad cards of an aggregator list; a card without a date has none."""
    m = rules.SUMMARY_CARD
    parsed = parse_elements(pages, ["div", "a", "p"], keys)
    elements = F.col("elements")
    jobs = F.get(F.filter(elements, lambda e: (e["tag"] == "div") & (attribute(e, "id") == m["list"])), 0)
    rows = cards_of(parsed, keys, all_of(inside(elements, jobs), "div", attr="id"))
    card, inner = F.col("card"), F.col("inner")
    meta, link = first_of(inner, "div", m["meta"]), first_of(inner, "a", attr="href")
    return rows.select(
        *keys, attribute(card, "data-id").alias("uniqueid"), text.capture_int(attribute(card, "id"), r"(\d+)").alias("dataid"),
        with_class(card, m["featured"]).cast("int").alias("i_featured"),
        dates.long_date(raw_text(meta)).alias("postdate"),
        text_of(link).alias("title"), attribute(link, "href").alias("href"),
        raw_text(first_of(part_of(inner, card, meta), "a")).alias("company"),
        text.clean_description(raw_text(first_of(inner, "p"))).alias("description"))


def board_cards(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ad cards of a job board list."""
    m = rules.BOARD_CARD
    parsed = parse_elements(pages, {"div": classes_of(m, "card"), "a": None, "time": None}, keys)
    rows = cards_of(parsed, keys, all_of(F.col("elements"), "div", m["card"]))
    href = F.get(F.split(attribute(first_of(F.col("inner"), "a", attr="href"), "href"), r"\?"), 0)
    stamp = attribute(first_of(F.col("inner"), "time", attr="title"), "title")
    return rows.select(
        *keys, text.capture(href, r"(?:jobs/p/|internship/)(\d+)-").cast("long").alias("uid"),
        href.alias("href"), stamp.alias("postdatetime"),
        dates.weekday_date(stamp).cast("date").alias("postdate"))


def resume_cards(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """People found by a resume search, with the status name still as text."""
    m = rules.RESUME_CARD
    parsed = parse_elements(pages, {"div": classes_of(m, "card"), "a": None, "h2": None, "h4": None,
                                    "h5": None, "p": None}, keys)
    rows = cards_of(parsed, keys, all_of(F.col("elements"), "div", m["card"]))
    inner = F.col("inner")
    country, region = text.location_split(raw_text(first_of(inner, "h5")))
    return rows.select(
        *keys, text.capture(attribute(first_of(inner, "a"), "href"), r"/profile/(\d+)\?").cast("long").alias("id"),
        text_of(first_of(inner, "h2", m["name"])).alias("name"),
        text_of(first_of(inner, "p")).alias("jobstat"), raw_text(first_of(inner, "h4")).alias("jobtitle"),
        country.alias("country"), region.alias("region"))


def region_counts(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Site map of regions: the n-th block of subregions belongs to the n-th region."""
    m = rules.SITE_MAP
    parsed = parse_elements(pages, {"div": ["bgef", "marginbott10"], "li": None}, keys)
    elements = F.col("elements")
    regions = all_of(elements, "div", m["region"])
    blocks = F.filter(elements, lambda e: (e["tag"] == "div") & with_class(e, m["subregions"])
                      & ~with_class(e, m["region"]))
    pairs = F.zip_with(regions, blocks, lambda r, b: F.struct(
        text_of(r).alias("region"), F.transform(all_of(inside(elements, b), "li"), text_of).alias("subregions")))
    rows = parsed.select(*keys, F.explode(pairs).alias("_p")).select(
        *keys, "_p.region", F.explode("_p.subregions").alias("subregion"))
    region, total = text.count_label(F.col("region"))
    subregion, posts = text.count_label(F.translate("subregion", "\n", ""))
    return rows.select(*keys, region.alias("region"), text.slug(region).alias("freg"),
                       total.alias("totalregposts"), subregion.alias("subregion"),
                       text.slug(subregion).alias("fsubreg"), posts.alias("subposts"))


def sector_counts(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sectors of a region page with their link and number of ads."""
    m = rules.SITE_MAP
    parsed = parse_elements(pages, {"a": classes_of(m, "sector"),
                                    "span": classes_of(m, "sector_name", "sector_count")}, keys)
    rows = cards_of(parsed, keys, all_of(F.col("elements"), "a", m["sector"]))
    count = text_of(first_of(F.col("inner"), "span", m["sector_count"]))
    return rows.select(
        *keys, text_of(first_of(F.col("inner"), "span", m["sector_name"])).alias("sector"),
        attribute(F.col("card"), "href").alias("href"),
        F.replace(count, F.lit(","), F.lit("")).try_cast("int").alias("totalposts"))


# Single pages


def classified_page(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ad page of a classifieds site. A page that is missing or closed has only its status."""
    m = rules.CLASSIFIED_PAGE
    parsed = parse_elements(pages, {
        "span": classes_of(m, "live"), "h1": None, "td": None, "th": None, "a": None, "p": None,
        "div": [*classes_of(m, "head", "views", "price", "user", "contact", "phone"), "clr"]}, keys)
    elements = F.col("elements")
    head = first_of(elements, "span", m["live"])
    content = F.get(F.filter(elements, lambda e: attribute(e, "id") == m["content"]), 0)
    cells = F.transform(all_of(elements, "td", m["cell"]), lambda c: F.struct(
        text_of(first_of(inside(elements, c), "th")).alias("key"),
        text_of(first_of(inside(elements, c), "td")).alias("value")))
    user = inside(elements, first_of(elements, "div", m["user"]))
    views = F.get(F.filter(all_of(elements, "div", m["views"]), lambda e: raw_text(e).contains("Views")), 0)
    since = r"On site since\s+(\w+)\s+(\d+)"
    age = text_of(first_of(user, "p", m["user_age"]))

    def says(name: str, phrase: str) -> Column:
        return F.coalesce(raw_text(first_of(elements, "div", m[name])).contains(phrase), F.lit(False)).cast("int")

    parts = parsed.select(
        *keys, F.when(elements.isNull(), "NOT FOUND").when(head.isNull(), "CLOSED").otherwise("OPEN").alias("stat"),
        text_of(head).alias("_head"), cells.alias("_cells"),
        raw_text(first_of(inside(elements, first_of(elements, "div", m["head"])), "h1")).alias("_title"),
        text.flatten_lines(text_of(content)).alias("description"),
        text.capture_int(raw_text(views), r"Views:\s*(\d+)").alias("pageviews"),
        text.money_digits(raw_text(first_of(elements, "div", m["price"]))).alias("compensation"),
        attribute(first_of(user, "a"), "href").alias("userhref"),
        text_of(first_of(user, "p", m["user_name"])).alias("username"),
        text.capture_int(age, since, 2).alias("userjoinyear"), text.capture(age, since).alias("userjoinmt"),
        says("contact", "Email Seller").alias("emailavail"), says("phone", "Show phone").alias("phoneavail"))
    posted = dates.clock_date(text.capture(F.col("_head"), r"at (\d+:\d+, \d+ \w+ \d+), Ad ID: \d+"))
    record = {
        "adid": text.capture(F.col("_head"), r"Ad ID: (\d+)").cast("long"),
        "postdate": posted.cast("date"), "posttime": F.date_format(posted, "HH:mm"),
        "title": F.col("_title"),
        **kv_columns(F.col("_cells"), rules.CLASSIFIED_FIELDS),
        **{c: F.col(c) for c in ("description", "pageviews", "compensation", "userhref", "username",
                                 "userjoinyear", "userjoinmt", "emailavail", "phoneavail")},
    }
    live = F.col("stat") == "OPEN"
    return parts.select(*keys, "stat", *[F.when(live, c).alias(n) for n, c in record.items()])


def board_page(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ad page of a job board: applicants count 0 and vacancies 1 where they are not given."""
    m = rules.BOARD_PAGE
    parsed = parse_elements(pages, {
        "div": classes_of(m, "closed", "main", "applicants", "stats", "summary", "about", "labels",
                          "requirements", "industries") + ["alert"],
        "h1": None, "a": None, "span": classes_of(m, "location", "vacancies"),
        "p": classes_of(m, "posted"), "dl": None, "meta": None, "li": None}, keys)
    elements = F.col("elements")

    def section(name: str) -> Column:
        return inside(elements, first_of(elements, "div", m[name]))

    # 'Salary: 1,000' lines of the summary, the name in the form of a column name.
    def line(e: Column) -> Column:
        flat = text.strip(F.regexp_replace(raw_text(e), r"\s+", " "))
        name = F.get(F.split(flat, ":"), 0)
        return F.struct(F.regexp_replace(F.lower(name), r"\s", "_").alias("key"),
                        text.strip(F.get(F.split(flat, ":"), 1)).alias("value"))

    roles = F.filter(section("about"), lambda e: e["tag"] == "a")
    parts = parsed.select(
        *keys, "page_text", "text_base", "elements",
        F.when(elements.isNull(), "NOT FOUND").when(first_of(elements, "div", m["closed"]).isNotNull(), "CLOSED")
        .otherwise("OPEN").alias("stat"),
        section("main").alias("_main"), F.transform(all_of(section("summary"), "dl"), line).alias("_lines"),
        joined(roles).alias("roles"), section("requirements").alias("_req"),
        joined(all_of(section("industries"), "a")).alias("industries"))
    main, required = F.col("_main"), F.col("_req")
    stamp = dates.weekday_date(attribute(first_of(main, "p", m["posted"]), "title"))
    counts = all_of(main, "div", m["stats"])
    fields = kv_columns(F.col("_lines"), {f: f for f in rules.BOARD_FIELDS})
    fields["languages"] = F.replace(fields["languages"], F.lit(","), F.lit(">"))
    fields["salary"] = text.salary_text(fields["salary"])
    keywords = attribute(first_of(required, "meta", attr="content"), "content")
    record = {
        "postdate": stamp.cast("date"), "posttime": F.date_format(stamp, "HH:mm"),
        "jobtitle": text_of(first_of(main, "h1", m["title"])),
        "company": text_of(first_of(main, "a", m["company"])),
        "location": text_of(first_of(main, "span", m["location"])),
        "num_applicants": number_of(first_of(main, "div", m["applicants"]), 0),
        "num_vacancies": number_of(first_of(main, "span", m["vacancies"]), 1),
        "num_seen": number_of(F.get(counts, 0), 0),
        "num_shortlisted": number_of(F.get(counts, 1), 0),
        "num_rejected": number_of(F.get(counts, 2), 0),
        **fields, "roles": F.col("roles"),
        "keywords": F.coalesce(F.replace(keywords, F.lit(", "), F.lit(">")), F.lit("")),
        "requirements": F.coalesce(joined(all_of(required, "li"), lambda e: text.strip_punct(raw_text(e))), F.lit("")),
        "industries": F.col("industries"),
    }
    return parts.select(*keys, "stat", *[F.when(main.isNotNull(), c).alias(n) for n, c in record.items()])


def ad_details(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ad page of an aggregator: key/value table, title, publisher image, description. Pages
    without the table give no row; see ``dead_pages``."""
    parsed = parse_elements(pages, {"table": ["job-details-table"], "h1": None, "th": None, "td": None,
                                    "img": None, "div": ["job-details"]}, keys)
    elements = F.col("elements")
    table = first_of(elements, "table", "job-details-table")
    image = text.capture(attribute(first_of(inside(elements, table), "img"), "src"), r"(thumb.*?\.(?:png|jpeg))$")
    title = F.get(F.filter(all_of(elements, "h1"), lambda e: attribute(e, "class").isNull()), 0)
    parts = parsed.filter(table.isNotNull()).select(
        *keys, detail_cells(inside(elements, table)).alias("_cells"), text_of(title).alias("title"),
        image.alias("pubimg"),
        text.clean_description(raw_text(first_of(elements, "div", "job-details"))).alias("description"))
    record = kv_columns(F.col("_cells"), rules.DETAIL_FIELDS)
    record["postdate"] = dates.long_date(record["postdate"])
    record["location"] = F.translate(record["location"], "\t", "")
    return parts.select(*keys, *[c.alias(n) for n, c in record.items()], "title", "pubimg", "description")


def dead_pages(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of aggregator pages that show a warning instead of an ad: their listings go."""
    parsed = parse_elements(pages, {"table": ["job-details-table"], "div": ["alert-warning"]}, keys)
    elements = F.col("elements")
    return parsed.filter(first_of(elements, "table").isNull() & first_of(elements, "div").isNotNull()).select(*keys)


def resume_page(pages: DataFrame, keys: Sequence[str], today: date) -> DataFrame:
    """Resume page as a nested document; ``error`` is set where the profile is gone."""
    m = rules.RESUME_PAGE
    parsed = parse_elements(pages, ["title", "div", "img", "h2", "h4", "p", "li", "button"], keys)
    elements = F.col("elements")
    header = first_of(elements, "div", m["header"])
    photo = first_of(elements, "div", m["photo"])
    top = parsed.select(
        *keys, "page_text", "text_base", "elements", inside(elements, header).alias("_top"), header.isNull().alias("_gone"),
        text.strip(F.get(F.split(raw_text(first_of(elements, "title")), r"\|"), 0)).alias("name"),
        F.when(photo.isNotNull(), (~attribute(first_of(inside(elements, photo), "img"), "src")
                                   .contains(m["no_photo"])).cast("int")).alias("has_photo"))
    blocks = F.transform(all_of(elements, "div", m["section"]), lambda b: text.let(inside(elements, b), lambda inner: F.struct(
        F.lower(text.strip(raw_text(first_of(inner, "h2")))).alias("key"),
        raw_text(F.get(F.filter(inner, lambda e: with_class(e, "row")), 0)).alias("text"),
        inner.alias("inner"), b["pos"].alias("pos"))))
    staged = top.select(
        *keys, "page_text", "text_base", "name", "has_photo", F.when(F.col("_gone"), "profile is deactivated").alias("error"),
        F.when(F.size("_top") > 0, F.col("_top")).alias("_top"), blocks.alias("_blocks"))
    head = F.col("_top")
    paragraphs = all_of(head, "p")

    def block(key: str) -> Column:
        return F.get(F.filter("_blocks", lambda b: b["key"] == key), 0)

    def fields(own: Column) -> Column:
        line = F.split(raw_text(first_of(own, "p")), r"\|")
        description = F.nullif(text_of(first_of(own, "div", m["description"])), F.lit(""))
        cells = F.struct(text.let(line, lambda x: F.struct(
            text.strip(F.get(x, 0)).alias("item1"), text.strip(F.get(x, 1)).alias("item2"))).alias("line"),
            description.alias("description"))
        return text.let(cells, lambda x: F.struct(
            dates.mixed_date(raw_text(first_of(own, "div", m["date"])), today).alias("date"),
            text_of(first_of(own, "div", m["subject"])).alias("subject"),
            F.when(~x["line"]["item1"].eqNullSafe(x["description"]), F.nullif(x["line"]["item1"], F.lit(""))).alias("item1"),
            x["line"]["item2"].alias("item2"), x["description"].alias("description")))

    def section(key: str, names: dict[str, str]) -> Column:
        renamed = [n for n in ("date", "subject", "item1", "item2", "description") if n in names]

        def items(found: Column) -> Column:
            lines = F.filter(found["inner"], lambda e: (e["tag"] == "li") & attribute(e, "style").isNotNull())
            return F.transform(lines, lambda li: text.let(
                text.let(part_of(found["inner"], found, li), fields), lambda x: F.struct(
                    *[x[n].alias(names[n]) for n in renamed])))

        return text.let(block(key), items)

    def texts(key: str, tag: str) -> Column:
        return F.transform(all_of(block(key)["inner"], tag), text_of)

    def languages(found: Column) -> Column:
        return F.transform(all_of(found["inner"], "li"), lambda li: text.let(
            part_of(found["inner"], found, li), lambda own: F.struct(
                text_of(first_of(own, "div", m["level"])).alias("level"),
                text_of(first_of(own, "div", m["language"])).alias("type"))))

    def pair(e: Column) -> Column:
        return text.let(F.split(raw_text(e), ":"), lambda parts: F.struct(
            text.strip(F.get(parts, 0)).alias("key"), text.strip(F.get(parts, 1)).alias("value")))

    personal = F.transform(all_of(block("personal information")["inner"], "div", m["personal"]), pair)
    return staged.select(
        *keys, "name", "has_photo", "error",
        text_of(first_of(head, "h4", m["location"])).alias("location"),
        text_of(F.get(F.filter(head, lambda e: (e["tag"] == "h4") & attribute(e, "class").isNull()), 0)).alias("title"),
        raw_text(F.get(paragraphs, 0)).alias("jobstatus"),
        F.when(F.size(paragraphs) == 2, dates.last_active(text_of(F.get(paragraphs, 1)), today)).alias("last_active"),
        personal.alias("personal"),
        *[section(key, names).alias(key) for key, names in rules.SECTION_FIELDS.items()],
        texts("skills", "button").alias("skills"), texts("interests", "button").alias("interests"),
        text.let(block("languages"), languages).alias("languages"),
        text.strip(block("summary")["text"]).alias("summary"))


def resume_documents(pages: DataFrame, today: date) -> DataFrame:
    """Resume pages (id, downloaddate, html) as the stored documents: ``resume_page`` with its
    dates, personal lines and sections in the form of the ``resumes`` table."""
    found = resume_page(pages, ["id", "downloaddate"], today)

    def lines(section: str, **dated: str) -> Column:
        names = [n for n in rules.SECTION_FIELDS[section].values() if n not in ("date", "date_start", "date_end")]
        return F.transform(section, lambda x: F.struct(
            *[x["date"][part].alias(name) for name, part in dated.items()], *[x[n].alias(n) for n in names]))

    known = F.filter("personal", lambda p: p["key"].isNotNull() & (p["key"] != ""))
    last = F.aggregate(known, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")),
                       lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    personal = F.when(F.col("personal").isNotNull(), last)

    def of(name: str) -> Column:
        return F.try_element_at(F.col("_personal"), F.lit(name))

    fields = found.withColumns({
        "_personal": personal, "education": lines("education", date="raw"), "projects": lines("projects", date="raw"),
        "experiences": lines("experiences", date_start="start", date_end="end")})
    return fields.withColumns({
        "gender": of("Gender"), "nationality": of("Nationality"), "birth_date": of("Birth Date"),
        "marital_status": of("Marital Status")}).drop("personal").withColumnRenamed("_personal", "personal")

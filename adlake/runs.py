"""The regular runs, put together from the operators. Each writes tables to a folder
of its own, given by the caller, so a run that is repeated overwrites only itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions import dates, features, text
from adlake.operators import combine, encode, maintenance, nested, page_records, stats, trends, worklist
from adlake.sources import partitioned
from adlake.sources import tables as store
from adlake.sources.schemas import KEYS, SCHEMAS


def _save(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def due_ads(listing: DataFrame, page: DataFrame, today: date, weeks: int = 15) -> DataFrame:
    """Ads to fetch today: the weekly rotation, without those known to be over."""
    due = worklist.weekly_rotation(listing, "postdate", today, weeks)
    return worklist.open_worklist(due, page, today).select("uid", "postdate", "href", "country").distinct()


def _added(rows: DataFrame, stored: DataFrame, table: str, arrival: Sequence[str] = ()) -> DataFrame:
    """Rows the stored table lacks; of one key the first by ``arrival`` columns, then by value."""
    order = [*arrival, *[c for c in SCHEMAS[table].fieldNames() if c not in (*KEYS[table], *arrival)]]
    return maintenance.first_wins(rows, KEYS[table], order, old=stored).to(SCHEMAS[table])


def list_run(cards: DataFrame, listing: DataFrame, marks: DataFrame, out: str, today: date, table: str = "listing",
             by: Sequence[str] = ("country",)) -> DataFrame:
    """Cards of list pages, from each group's high-water mark on, that the listing lacks. A group
    without a mark starts 29 days before ``today``.

    ``cards`` comes from ``page_records``, with the group's columns as keys.
    """
    rows = _save(worklist.since_mark(cards, marks, by, "postdate", today).to(SCHEMAS[table]), f"{out}/cards")
    return _save(_added(rows, listing, table), f"{out}/{table}")


def load_run(fetched: DataFrame, listing: DataFrame, page: DataFrame, out: str, today: date,
             archived: DataFrame | None = None, table: str = "page",
             parse: Callable[[DataFrame, Sequence[str]], DataFrame] = page_records.classified_page,
             ) -> dict[str, DataFrame]:
    """Fetched pages to rows, rows into the page table, then the archive split.

    ``fetched`` has country, uid, postdate (of the listing), downloaddate, downloadtime and
    html. Written to ``out``: ``archive`` (rows moved today), ``page`` and ``listing`` (what
    stays live). ``archived`` holds the keys of earlier archives. For the job board give
    ``parse=page_records.board_page, table="job_page"``.
    """
    keys = ["country", "uid", "listed", "downloaddate", "downloadtime"]
    parsed = parse(fetched.withColumnRenamed("postdate", "listed"), keys)
    # The date on the page is the better one.
    rows = parsed.withColumn("postdate", F.coalesce("postdate", "listed")).to(SCHEMAS[table])
    # Written, so that the parse is not repeated by each step that reads its rows.
    rows = _save(rows, f"{out}/parsed")
    pages = page.unionByName(_save(_added(rows, page, table, ["downloadtime"]), f"{out}/added"))
    gone = maintenance.gone_ads(pages, today)
    over = [gone] if archived is None else [gone, archived]
    return {
        "archive": _save(maintenance.archive_moved(pages, gone), f"{out}/archive"),
        "page": _save(maintenance.archive_live(pages, over), f"{out}/page"),
        "listing": _save(maintenance.archive_live(listing, over), f"{out}/listing"),
    }


def archive_run(spark: SparkSession, page: str, listing: str, archive: str, out: str, today: date,
                by: Sequence[str] = ("country",), kinds: tuple[str, str] = ("page", "listing"),
                max_days: int = maintenance.PAST_DAYS) -> dict[str, int]:
    """Move ads that are over from the stored page and listing tables to the archive, in place.

    All three are paths of tables partitioned ``by`` (``kinds`` names the schemas of the first two); the archive also has ``moved`` (the day) as its first
    partition. Only partitions that hold an ad that is over, or an archived listing, are written again;
    the number of those is returned per table. What is moved and what stays is written under ``out``
    before a table is changed, so a run that broke off can be repeated with the same ``out``.
    """
    by = list(by)
    pages, ads = (spark.read.schema(SCHEMAS[k]).parquet(path) for k, path in zip(kinds, (page, listing)))
    gone = partitioned.staged(spark, f"{out}/gone", lambda: maintenance.gone_ads(pages, today, max_days))
    moved = partitioned.staged(spark, f"{out}/moved", lambda: maintenance.archive_moved(pages, gone))
    work = {}
    for name, table, rows in (("page", page, pages), ("listing", listing, ads)):
        touched = partitioned.staged(spark, f"{out}/{name}-touched", lambda rows=rows: rows.join(gone, "uid", "left_semi")
                                     .select(*by).distinct()).collect()   # one row a partition
        kept = partitioned.staged(spark, f"{out}/{name}-kept", lambda rows=rows, touched=touched: maintenance.archive_live(
            rows.filter(partitioned.of_partitions(by, touched)), [gone]))
        work[name] = (table, touched, kept)
    if not moved.isEmpty():
        store.refresh_partitions(moved.withColumn("moved", F.lit(today)), archive, ["moved", *by])
    for table, touched, kept in work.values():
        partitioned.replace_touched(table, by, touched, kept)
    return {name: len(touched) for name, (_, touched, _) in work.items()}


def detail_run(fetched: DataFrame, summary: DataFrame, detail: DataFrame, out: str) -> dict[str, DataFrame]:
    """Aggregator pages (country, uniqueid, html): new details, and the summaries without
    those whose page is dead."""
    keys = ["country", "uniqueid"]
    rows = _save(page_records.ad_details(fetched, keys).to(SCHEMAS["ad_detail"]), f"{out}/parsed")
    dead = page_records.dead_pages(fetched, keys)
    return {
        "detail": _save(_added(rows, detail, "ad_detail"), f"{out}/detail"),
        "summary": _save(maintenance.remove_dead(summary, dead, keys), f"{out}/summary"),
    }


def people_run(fetched: DataFrame, links: DataFrame, names: DataFrame, out: str) -> dict[str, DataFrame]:
    """Resume search pages (srchtitle, srchcountry, day, page, html): status names with the
    new ones added, and the links not stored yet."""
    keys = ["srchtitle", "srchcountry", "day", "page"]
    cards = _save(page_records.resume_cards(fetched, keys), f"{out}/cards")
    seen = ["day", "srchcountry", "srchtitle", "page", "id"]
    names = _save(maintenance.extend_status_names(names, cards, "jobstat", seen, F.col("day")), f"{out}/status_names")
    coded = combine.left_with(cards, names.select("jobstat", F.col("id").alias("jobstatid")), ["jobstat"])
    new = _added(coded, links, "resume_links", ["day", "page"])
    return {"status_names": names, "links": _save(new, f"{out}/links")}


def load_resumes(fetched: DataFrame, stored: DataFrame, links: DataFrame, out: str, today: date) -> dict[str, DataFrame]:
    """Fetched resume pages (id, downloaddate, html) into the stored documents.

    The raw pages are kept by day; pages of known links are parsed and upserted, documents that
    are fresh stay. ``missing`` are the linked resumes that are still not stored.
    """
    wanted = worklist.within(fetched, links, ["id"])
    store.save_raw_pages(wanted, f"{out}/raw", today, uid="id")
    parsed = _save(page_records.resume_documents(wanted, today).to(SCHEMAS["resumes"]), f"{out}/parsed")
    documents = _save(maintenance.stale_upsert(stored, parsed, "id", "downloaddate", today), f"{out}/documents")
    missing = worklist.without(links.select("id").distinct(), documents, ["id"])
    return {"documents": documents, "missing": _save(missing, f"{out}/missing")}


def store_translations(translated: DataFrame, stored: DataFrame, out: str) -> DataFrame:
    """Items with a translation (as from ``resume_run``) that the stored table lacks; the first
    of a key by value counts."""
    done = translated.filter("needs AND translated IS NOT NULL").withColumnRenamed("translated", "translation_en")
    new = _added(done.withColumn("downloaddate", F.to_date("downloaddate")), stored, "translations")
    return _save(new, f"{out}/translations")


def load_counts(regions: DataFrame, sectors: DataFrame, stored_regions: DataFrame, stored_sectors: DataFrame,
                out: str) -> dict[str, DataFrame]:
    """Site map pages to count rows, and the segments to fetch next.

    ``regions`` and ``sectors`` are the rows of ``region_counts`` and ``sector_counts`` with the
    columns of their tables.
    """
    counts = stored_regions.unionByName(_save(_added(regions, stored_regions, "region_counts"), f"{out}/region_counts"))
    loaded = stored_sectors.unionByName(
        _save(_added(sectors, stored_sectors, "region_sector_counts"), f"{out}/region_sector_counts"))
    due = worklist.segments_to_fetch(counts, loaded, ["region", "subregion"], ["region", "subregion", "downloaddate"],
                                     total="subposts")
    return {"region_counts": counts, "region_sector_counts": loaded, "segments": _save(due, f"{out}/segments")}


def load_summaries(links: DataFrame, cards: DataFrame, stored_links: DataFrame, stored: DataFrame, out: str) -> dict[str, DataFrame]:
    """Category links of the aggregator, renewed for the countries loaded, and summary cards that
    the stored table lacks. ``cards`` comes from ``summary_cards`` with country, cat and subcat as keys."""
    countries = [r["country"] for r in links.select("country").distinct().collect()]  # a row per site
    # Written, so that the parse is not repeated by each step that reads its rows.
    cards = _save(cards, f"{out}/cards")
    renewed = maintenance.refresh_partition(stored_links, links.to(SCHEMAS["category_links"]), "country", countries)
    return {"category_links": _save(renewed, f"{out}/category_links"),
            "summary": _save(_added(cards, stored, "ad_summary"), f"{out}/summary")}


def _encoded(ads: DataFrame, columns: Sequence[str], path: str) -> tuple[DataFrame, list[str]]:
    """Rare values collapsed, then an indicator column per value that is left.

    The collapsed rows are written once; the values of all columns then come from one aggregate over these columns.
    """
    common = _save(encode.collapse_rare(ads, columns), path)
    # At most 1 / share values and the one for the rest are left of a column.
    left = common.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return encode.one_hot(common, {c: left[f"v{i}"] for i, c in enumerate(columns)})


def classified_features(listing: DataFrame, page: DataFrame, out: str, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Feature table of the classifieds site and its means by country and sector.

    The latest page of each ad beside its listing, without the sectors in ``exclude``.
    """
    ads = combine.left_with(combine.latest_snapshot(page, ["uid"], "downloaddate"),
                            listing.drop("country"), ["uid", "postdate"])
    for sector in exclude:
        ads = ads.filter(combine.differs(F.col("jobsector"), sector))
    flags = {name: features.member_flag(F.col(c), values) for name, (c, values) in rules.MEMBER_FLAGS.items()}
    ads = ads.withColumns({
        "daysposted": dates.days_between(F.col("downloaddate"), F.col("postdate")), "month": dates.month_start(F.col("postdate")),
        **flags, **features.compensation(F.col("compensation"))})
    hot, names = _encoded(_save(ads, f"{out}/ads"), rules.ENCODE_COLUMNS, f"{out}/collapsed")
    hot = _save(hot, f"{out}/features")
    means = stats.summary_stats(hot, ["country", "jobsector"], "uid", [*rules.AVERAGE_COLUMNS, *flags, *names])
    return {"features": hot, "summary": _save(means, f"{out}/summary")}


def board_features(listing: DataFrame, page: DataFrame, out: str, names: DataFrame) -> dict[str, DataFrame]:
    """Feature table of the job board, its means by country and first industry, and its profile by day.

    ``names`` (k, v) maps companies to the name they go by.
    """
    latest = combine.latest_snapshot(page, ["uid"], "downloaddate")
    ads = combine.left_with(latest, listing.select("uid", "postdate", "href"), ["uid", "postdate"])
    low, high = features.experience_range(F.col("experience_needed"))
    wanted = text.normalise_requirements(F.lower("requirements"))
    ads = ads.withColumns({
        "expmin": low, "expmax": high, "vacancies": features.vacancies(F.col("vacancies")),
        "req_num": features.requirement_lines(F.col("requirements")), "req_bachelors": features.has_text(F.lower("requirements")),
        "province": features.province(features.full_address(F.col("location"))),
        "education_level": features.education_level(F.col("education_level"), F.col("requirements")),
        "days_posted": dates.days_between(F.col("downloaddate"), F.col("postdate")),
        "tokens": text.clean_tokens(wanted)})
    ads = encode.first_items(combine.map_or_keep(ads, "company", names), "industries", "ind")
    ads = _save(encode.skill_tags(ads, "tokens").drop("tokens"), f"{out}/ads")
    industries = encode.indicator_values(ads, "ind0")
    ads = encode.multi_hot(ads, ["ind0", "ind1", "ind2"], industries, "industry", rest="other")
    hot, new = _encoded(ads, rules.ENCODE_JOB_COLUMNS, f"{out}/collapsed")
    hot = _save(hot, f"{out}/features")
    means = stats.summary_stats(hot, ["country", "ind0"], "uid", [*rules.AVERAGE_JOB_COLUMNS, *new])
    return {"features": hot, "summary": _save(means, f"{out}/summary"),
            "profile": _save(stats.profile_by(hot, "downloaddate", rules.AVERAGE_JOB_COLUMNS), f"{out}/profile")}


def analysis_run(listing: DataFrame, page: DataFrame, out: str, uid: str, category: str,
                 averages: Sequence[str], categories: Sequence[str] | None = None,
                 several: bool = False) -> dict[str, DataFrame]:
    """Missing values, weighted ad counts with their trends, and the summary table.

    With ``several`` the category is a list such as ``a>b>c``: an ad counts 1/k in each of its k.

    The monthly table is written first and all trends are made from it; the ads are read
    once for it.
    """
    ads = listing.select("country", F.col(uid).alias("uid"), F.col(category).alias("cat"), "postdate")
    if several:
        items = F.filter(F.transform(text.split_list(F.col("cat")), text.clean_item), lambda x: x != "")
        ads = ads.withColumn("cat", F.explode_outer(items))
    months = _save(trends.category_months(ads), f"{out}/category_months")
    tables = {
        "missing_listing": stats.missing_pct(listing, listing.columns),
        "missing_page": stats.missing_pct(page, page.columns),
        "totals": trends.category_totals(months), "countries": trends.country_totals(months),
        "top": trends.top_categories(months), "top_share": trends.top_share(months),
        "span": trends.month_span(months), "change": trends.category_change(months),
        "summary": stats.summary_stats(listing, ["country", category], uid, averages),
    }
    if categories:
        tables["pivot"] = trends.pivot_months(months, categories)
    return {"category_months": months, **{n: _save(df, f"{out}/{n}") for n, df in tables.items()}}


def resume_run(resumes: DataFrame, links: DataFrame, glossary: DataFrame, out: str, today: date,
               titles: Sequence[str] = ("Engineering", "Marketing", "Sales"),
               group_size: int = 100) -> dict[str, DataFrame]:
    """Availability and activity of resumes, users per country, valid resumes, and the texts
    that still wait for a translation."""
    docs = maintenance.drop_errors(resumes).withColumns({
        "birth_date": dates.birth_date(F.col("birth_date")),
        "marital_status": text.sentinel_null(F.col("marital_status"))})
    fields = [c for c in docs.columns if c not in ("id", "error")]
    chosen = links.filter(F.col("srchtitle").isin(list(titles)))
    found = combine.left_with(chosen.select("id", "country", "srchtitle").distinct(), docs, ["id"])
    items = nested.unnest_long(docs, ["id", "downloaddate"], rules.TRANSLATED_FIELDS)
    translated = _save(nested.translate_items(items, "text", glossary), f"{out}/translated")
    tables = {
        "available": stats.available_pct(docs, fields),
        "available_by_nationality": stats.available_by_group(docs, "nationality", fields, group_size),
        "gender": stats.value_share(docs, "nationality", "gender", group_size),
        "active": stats.active_within(docs, "last_active", today),
        "users": stats.user_stats(links, docs, "id", today),
        "links": stats.count_by(chosen, ["country", "srchtitle"], "id"),
        "valid": combine.complete_rows(found, ["education", "experiences", "skills"]),
        "no_translation": nested.nothing_to_translate(
            docs, translated.filter("needs"), ["id", "downloaddate"]),
    }
    return {"translated": translated, **{n: _save(df, f"{out}/{n}") for n, df in tables.items()}}

"""The load runs over the given tables: what arrives, what is stored, and what comes of it.

Stored tables are made of the same rows with other values, so that a stored row which was
wrongly replaced, or a new one which was wrongly dropped, shows.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from adlake import runs
from adlake.operators import nested, page_records
from adlake.plans import roles
from adlake.plans.documents import FOREIGN, GLOSSARY
from adlake.plans.page_kinds import PEOPLE, resume_pages, summary_pages
from adlake.plans.registry import query
from adlake.plans.roles import LISTING, TODAY
from adlake.session import scratch_path
from adlake.sources.schemas import SCHEMAS


def stored_as(df, table):
    """The frame in the schema of a table; columns it lacks are null."""
    missing = [f for f in SCHEMAS[table].fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).to(SCHEMAS[table])


# Site map counts: stored up to KNOWN, fetched again from FETCHED on; sectors are loaded up to SEEN.
FETCHED, KNOWN, SEEN = date(2024, 1, 15), date(2024, 1, 20), date(2024, 1, 25)


@query("load_counts", f"""WITH base AS (
        SELECT CAST(ts AS DATE) AS downloaddate, 'r' || user_id AS region, event_type AS subregion, count(*) AS n
        FROM events GROUP BY ALL),
    counts AS (SELECT downloaddate, region, subregion, n + 1 AS subposts FROM base WHERE downloaddate <= DATE '{KNOWN}'
        UNION ALL SELECT * FROM base WHERE downloaddate > DATE '{KNOWN}'),
    sectors AS (SELECT DISTINCT downloaddate, region, subregion FROM base
        WHERE downloaddate <= DATE '{SEEN}' OR subregion <> 'purchase'),
    due AS (SELECT c.region, c.subregion FROM counts c JOIN counts e ON c.region = e.region AND c.subregion = e.subregion
            AND c.downloaddate = e.downloaddate + 2 AND c.subposts <> e.subposts
            WHERE c.downloaddate >= (SELECT max(downloaddate) FROM counts) - 5
        UNION SELECT region, subregion FROM counts c WHERE NOT EXISTS (SELECT 1 FROM sectors s
            WHERE s.region = c.region AND s.subregion = c.subregion AND s.downloaddate = c.downloaddate))
    SELECT c.region, c.subregion, count(*) AS days, CAST(sum(subposts) AS BIGINT) AS posts, bool_or(d.region IS NOT NULL) AS due
    FROM counts c LEFT JOIN due d ON c.region = d.region AND c.subregion = d.subregion GROUP BY ALL""")
def load_counts(t):
    day = ["downloaddate", "region", "subregion"]
    rows = t.events.select(F.col("ts").cast("date").alias("downloaddate"),
                           F.concat(F.lit("r"), "user_id").alias("region"), F.col("event_type").alias("subregion"))
    base = rows.groupBy(*day).agg(F.count(F.lit(1)).cast("int").alias("subposts"))
    stored = base.filter(F.col("downloaddate") <= F.lit(KNOWN)).withColumn("subposts", F.col("subposts") + 1)
    sectors = base.select(*day, F.lit("all").alias("sector"), F.col("subposts").alias("totalposts"))
    seen = sectors.filter(F.col("downloaddate") <= F.lit(SEEN))
    made = runs.load_counts(
        stored_as(base.filter(F.col("downloaddate") >= F.lit(FETCHED)), "region_counts"),
        stored_as(sectors.filter((F.col("subregion") != "purchase") & (F.col("downloaddate") >= F.lit(FETCHED))), "region_sector_counts"),
        stored_as(stored, "region_counts"), stored_as(seen, "region_sector_counts"), scratch_path(t.spark, "load-counts"))
    segments = made["segments"].withColumn("due", F.lit(True))
    totals = made["region_counts"].groupBy("region", "subregion").agg(
        F.count(F.lit(1)).alias("days"), F.sum("subposts").alias("posts"))
    return totals.join(segments, ["region", "subregion"], "left").withColumn("due", F.coalesce("due", F.lit(False)))


# Aggregator: the links of three sites are fetched, cards of every ad; those of open ads are stored.
SITES = ["ASIA", "EUROPE", "AFRICA"]


def _summaries(t):
    places = roles.places(t).groupBy(F.col("r_name").alias("country"), F.col("c_mktsegment").alias("cat"), F.col("n_name").alias("subcat")).count()
    href = F.concat(F.lit("/"), "subcat", F.lit("/"), "cat")
    stored_links = places.select("country", "cat", "subcat", href.alias("href"), F.lit(date(2001, 1, 1)).alias("downloaddate"))
    links = (stored_links.filter(F.col("country").isin(SITES) & (F.col("cat") != "BUILDING"))
             .withColumn("downloaddate", F.lit(TODAY)))
    keys = ["country", "cat", "subcat"]
    cards = page_records.summary_cards(summary_pages(t).select(*keys, "html"), keys)
    known = roles.listing(t).filter("stat = 'OPEN'").select(
        F.concat(F.lit("u"), "uid").alias("uniqueid"), "postdate", F.lit("stored").alias("title"))
    return runs.load_summaries(links, cards, stored_as(stored_links, "category_links"), stored_as(known, "ad_summary"),
                               scratch_path(t.spark, "load-summaries"))


@query("load_summaries", f"""WITH {LISTING} SELECT country, category AS cat, region AS subcat, 'u' || uid AS uniqueid,
        CASE WHEN stat <> 'CLOSED' THEN postdate END AS postdate, category AS title, '/jobs/' || uid AS href,
        CAST(level = '1-URGENT' AS INTEGER) AS i_featured
    FROM listing WHERE stat <> 'OPEN'""")
def load_summaries(t):
    return _summaries(t)["summary"].select("country", "cat", "subcat", "uniqueid", "postdate", "title", "href", "i_featured")


@query("load_links", f"""WITH {PEOPLE}, old AS (SELECT DISTINCT r_name AS country, c_mktsegment AS cat, n_name AS subcat FROM people)
    SELECT *, '/' || subcat || '/' || cat AS href,
        CASE WHEN country IN ({", ".join(f"'{s}'" for s in SITES)}) THEN DATE '{TODAY}' ELSE DATE '2001-01-01' END AS downloaddate
    FROM old WHERE country NOT IN ({", ".join(f"'{s}'" for s in SITES)}) OR cat <> 'BUILDING'""")
def load_links(t):
    return _summaries(t)["category_links"].select("country", "cat", "subcat", "href", "downloaddate")


# Resumes: every other customer is stored, a third of these long ago; those in debt are not linked.
FRESH, STALE = datetime(2001, 7, 20), datetime(2001, 5, 1)


@query("load_resumes", f"""WITH {PEOPLE}, known AS (SELECT *, c_custkey % 2 = 0 AS stored, c_custkey % 3 = 0 AS stale,
        c_acctbal > 0 AS linked, c_mktsegment = 'BUILDING' AS gone FROM people),
    done AS (SELECT *, linked AND (NOT stored OR stale) AS loaded FROM known WHERE linked OR stored)
    SELECT c_custkey AS id, 'document' AS part,
        CASE WHEN loaded THEN DATE '{TODAY}' WHEN stale THEN DATE '{STALE.date()}' ELSE DATE '{FRESH.date()}' END AS day,
        CASE WHEN loaded AND gone THEN 'profile is deactivated' END AS error,
        CASE WHEN NOT loaded THEN 'stored' WHEN NOT gone THEN r_name END AS nationality,
        CASE WHEN loaded AND NOT gone THEN 2::INTEGER END AS schools
    FROM done
    UNION ALL SELECT c_custkey + 10000000, 'missing', NULL, NULL, NULL, NULL FROM customer WHERE c_acctbal > 5000""")
def load_resumes(t):
    people = roles.places(t).select("c_custkey", "c_acctbal")
    fetched = resume_pages(t).withColumn("downloaddate", F.lit(datetime(TODAY.year, TODAY.month, TODAY.day)))
    stored = people.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.lit("stored").alias("nationality"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(STALE)).otherwise(F.lit(FRESH)).alias("downloaddate"))
    known = people.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    unseen = people.filter("c_acctbal > 5000").select((F.col("c_custkey") + 10_000_000).alias("id"))
    made = runs.load_resumes(fetched, stored_as(stored, "resumes"), stored_as(known.unionByName(unseen), "resume_links"),
                             scratch_path(t.spark, "load-resumes"), TODAY)
    live = F.col("error").isNull()
    documents = made["documents"].select(
        "id", F.lit("document").alias("part"), F.to_date("downloaddate").alias("day"), "error",
        F.when(live, F.col("nationality")).alias("nationality"),
        F.when(live & F.col("education").isNotNull(), F.size("education")).alias("schools"))
    missing = made["missing"].select("id", F.lit("missing").alias("part"))
    return documents.unionByName(missing, allowMissingColumns=True)


@query("store_translations", rf"""WITH words AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
    items AS (SELECT doc_id, lang, source, unnest(w) AS item, CAST(unnest(range(len(w))) AS INTEGER) AS listnum FROM words),
    glossary(s, t) AS (VALUES {", ".join(f"('{s}', '{t}')" for s, t in GLOSSARY)})
    SELECT doc_id AS id, DATE '{TODAY}' AS downloaddate, lang AS column1, source AS column2, listnum, t AS translation_en
    FROM items JOIN glossary ON item = s WHERE doc_id % 3 <> 0""")
def store_translations(t):
    found = t.documents.select(F.col("doc_id").alias("id"), F.lit(TODAY).alias("downloaddate"), F.col("lang").alias("column1"),
                               F.col("source").alias("column2"), F.posexplode(F.regexp_extract_all(
                                   "text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("listnum", "text"))
    glossary = t.spark.createDataFrame(GLOSSARY, "source string, target string")
    items = nested.translate_items(found, "text", glossary, needs=F.col("text").rlike(FOREIGN))
    stored = items.filter("needs AND translated IS NOT NULL AND id % 3 = 0").withColumn("translation_en", F.lit("stored"))
    return runs.store_translations(items, stored_as(stored.drop("needs", "translated", "text"), "translations"),
                                   scratch_path(t.spark, "translations"))

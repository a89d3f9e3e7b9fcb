"""Nested resumes, page parsing and incremental loading."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from adlake.functions import html, text
from adlake.operators import nested, pages, worklist
from adlake.plans import roles
from adlake.plans.registry import query
from adlake.plans.roles import COUNTS
from adlake.session import scratch_path
from adlake.sources.tables import spread
from adlake.streaming import incremental, ingest

# Resumes: the turns of a conversation are the items of a document, the role its section.


def resume_items(t):
    return nested.nest_sections(t.conversations, "conv_id", "role", "turn", ["text"])


@query("nest_sections", """SELECT conv_id, role, count(*) AS items, arg_min(text, turn) AS first_text
    FROM conversations GROUP BY conv_id, role""")
def nest_sections(t):
    return nested.section_summary(resume_items(t), "conv_id", "role", "text")


@query("unnest_long", "SELECT conv_id, role, 'text' AS field, turn, text FROM conversations")
def unnest_long(t):
    return nested.unnest_parts(resume_items(t), "conv_id", "role", "turn", ["text"])


@query("unnest_sections", """SELECT doc_id, 'languages' AS column1, 'type' AS column2, 0::INTEGER AS listnum,
        lang AS text FROM documents UNION ALL
    SELECT doc_id, 'summary', 'summary', 0::INTEGER, source FROM documents WHERE lang <> 'en' UNION ALL
    SELECT doc_id, 'skills', 'skills', CAST(i - 1 AS INTEGER), lines[i] FROM (
        SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
            SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def unnest_sections(t):
    docs = t.documents.select(
        "doc_id", F.array(F.struct(F.lit("native").alias("level"), F.col("lang").alias("type"))).alias("languages"),
        F.split("text", "\n").alias("skills"), F.when(F.col("lang") != "en", F.col("source")).alias("summary"))
    return nested.unnest_long(docs, ["doc_id"], {"skills": [""], "languages": ["type"], "summary": [""]})


@query("resume_sections", """WITH cards AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'education'
        WHEN 'assistant' THEN 'experiences' ELSE 'projects' END AS section FROM conversations)
    SELECT conv_id, CAST(count(*) FILTER (section = 'education') AS INTEGER) AS schools,
        arg_min(text, turn) FILTER (section = 'education') AS degree,
        CAST(count(*) FILTER (section = 'experiences') AS INTEGER) AS jobs,
        arg_min(text, turn) FILTER (section = 'experiences') AS company,
        CAST(count(*) FILTER (section = 'projects') AS INTEGER) AS projects,
        arg_max('turn ' || turn, turn) FILTER (section = 'projects') AS project FROM cards GROUP BY conv_id""")
def resume_sections(t):
    section = (F.when(F.col("role") == "user", "education").when(F.col("role") == "assistant", "experiences")
               .otherwise("projects"))
    cards = t.conversations.select(
        "conv_id", section.alias("section"), F.col("turn").alias("listnum"), F.lit("2015").alias("date"),
        F.format_string("turn %d", F.col("turn")).alias("subject"), F.col("text").alias("item1"),
        F.lit(None).cast("string").alias("item2"), F.lit(None).cast("string").alias("description"))
    docs = nested.resume_sections(cards, "conv_id")

    def size(c):
        return F.coalesce(F.size(c), F.lit(0))

    return docs.select(
        "conv_id", size("education").alias("schools"), F.get("education", 0)["degree"].alias("degree"),
        size("experiences").alias("jobs"), F.get("experiences", 0)["company"].alias("company"),
        size("projects").alias("projects"), F.try_element_at("projects", F.lit(-1))["name"].alias("project"))


EVENT_TYPES = ["signup", "purchase", "error", "view", "click"]


@query("kv_columns", "SELECT user_id, " + ", ".join(
    f"arg_max(value, (ts, event_id)) FILTER (event_type = '{k}') AS \"{k}\"" for k in EVENT_TYPES)
    + " FROM events GROUP BY user_id")
def kv_columns(t):
    return nested.last_values(t.events, "user_id", "event_type", "value", ["ts", "event_id"], EVENT_TYPES)


GLOSSARY = [("Éreoi", "first"), ("Über", "over"), ("Él", "he"), ("Óos", "bones")]
FOREIGN = r"^[^\x{00}-\x{7f}]"


def words(t):
    """Every different word of every text is an item."""
    return t.documents.select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all(
        "text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))).alias("item"))


def translated(t):
    glossary = t.spark.createDataFrame(GLOSSARY, "source string, target string")
    return nested.translate_items(words(t), "item", glossary, needs=F.col("item").rlike(FOREIGN))


ITEMS = r"""items AS (SELECT doc_id, lang, item, regexp_matches(item, '^[^\x{00}-\x{7f}]') AS needs
    FROM (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS item FROM documents))"""


@query("needs_translation", f"""WITH {ITEMS}, glossary(s, t) AS (
        VALUES {", ".join(f"('{s}', '{t}')" for s, t in GLOSSARY)})
    SELECT doc_id, lang, item, needs, CASE WHEN needs THEN t ELSE item END AS translated
    FROM items LEFT JOIN glossary ON item = s""")
def needs_translation(t):
    return translated(t)


@query("nothing_to_translate", f"""WITH {ITEMS} SELECT doc_id FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM items WHERE needs)""")
def nothing_to_translate(t):
    return nested.nothing_to_translate(t.documents, words(t).filter(F.col("item").rlike(FOREIGN)), ["doc_id"])


# Pages


def page_texts(t):
    return spread(t.pages)


def unescape_sql(expression: str) -> str:
    for entity, char in (("quot", "'\"'"), ("copy", "'©'"), ("middot", "'·'"), ("lt", "'<'"), ("gt", "'>'"),
                         ("amp", "'&'")):
        # HTML reads these entities without the semicolon too.
        expression = f"regexp_replace({expression}, '&{entity};?', {char}, 'g')"
    return expression


@query("html_unescape", f"SELECT page_id, md5({unescape_sql('html')}) AS digest FROM pages")
def html_unescape(t):
    return page_texts(t).select("page_id", F.md5(text.html_unescape(F.col("html"))).alias("digest"))


BLOCKS = "|".join(sorted(html.BLOCK))


@query("html_text", rf"""WITH bare AS (SELECT page_id, {unescape_sql(
        f"regexp_replace(regexp_replace(replace(regexp_replace(html,"
        f" '<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), chr(10), ' '),"
        f" '</?({BLOCKS})( [^>]*)?>', chr(10), 'g'), '<[^>]+>', '', 'g')")} AS t FROM pages)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM bare""")
def html_text(t):
    return html.plain_text(page_texts(t))


STRIP = r"'^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'"
LINKS = r"""links AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS link,
    unnest(range(len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')))) AS i FROM pages)"""
LABEL = f"regexp_replace({unescape_sql('''regexp_extract(link, '>([^<]+)</a>', 1)''')}, {STRIP})"
HREF = unescape_sql("""regexp_extract(link, 'href="([^"]*)"', 1)""")


@query("listing_rows", rf"""WITH {LINKS} SELECT page_id, CAST(2 * i + 1 AS INTEGER) AS pos, {LABEL} AS title,
    string_split({HREF}, '?')[1] AS href, nullif(regexp_extract({HREF}, '^/(.+)$', 1), '') AS uid,
    0::INTEGER AS i_featured FROM links""")
def listing_rows(t):
    parsed = html.parse_elements(page_texts(t), ["li", "a"], keep=["page_id"])
    return pages.listing_rows(parsed, id_pattern=r"^/(.+)$")


@query("category_links", rf"""WITH {LINKS}, labelled AS (
        SELECT page_id, CAST(i AS INTEGER) AS pos, {LABEL} AS label, {HREF} AS href, '' AS img FROM links)
    SELECT * FROM labelled WHERE regexp_matches(label, '^[\p{{L}}\p{{N}}_]')""")
def category_links(t):
    return pages.category_links(html.parse_elements(page_texts(t), ["a", "img"], keep=["page_id"]))


def _title_sql(tag: str) -> str:
    inner = f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1, 's')"
    return f"regexp_replace({unescape_sql(inner)}, {STRIP})"


@query("page_record", rf"""SELECT page_id, url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    {_title_sql("title")} AS title, {_title_sql("h1")} AS h1,
    CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs,
    CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS list_items,
    CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS links FROM pages""")
def page_record(t):
    return pages.page_record(html.parse_elements(page_texts(t), ["html", "title", "h1", "p", "li", "a"]))


@query("page_status", """SELECT doc_id, CASE WHEN html IS NULL THEN 'NOT FOUND'
        WHEN NOT contains(html, 'example.com') THEN 'CLOSED' ELSE 'OPEN' END AS stat
    FROM documents LEFT JOIN pages ON doc_id = page_id""")
def page_status(t):
    # The page is cut down to its status before the join, so no page text is shuffled.
    known = t.pages.select(F.col("page_id").alias("doc_id"),
                           worklist.page_status(F.col("html"), "example.com").alias("stat"))
    return t.documents.select("doc_id").join(known, "doc_id", "left").select(
        "doc_id", F.coalesce("stat", F.lit("NOT FOUND")).alias("stat"))


@query("segment_counts", f"""WITH {COUNTS},
    totals AS (SELECT downloaddate, region, sum(totalposts) AS n FROM counts GROUP BY ALL)
    SELECT c.downloaddate, 'Region ' || c.region AS region, 'region-' || c.region AS freg,
        CAST(n AS INTEGER) AS totalregposts, c.sector AS subregion, c.sector AS fsubreg,
        CAST(totalposts AS INTEGER) AS subposts
    FROM counts c JOIN totals t ON c.downloaddate = t.downloaddate AND c.region = t.region""")
def segment_counts(t):
    # One site-map line per region and day; the sectors of a line are at most the event types.
    def label(name, n):
        return F.concat(name, F.lit(" ("), F.format_number(n, 0), F.lit(")"))

    lines = roles.counts(t).groupBy("downloaddate", "region").agg(
        F.sum("totalposts").alias("n"),
        F.collect_list(label(F.col("sector"), F.col("totalposts"))).alias("sectors"))
    lines = lines.withColumn("line", label(F.concat(F.lit("Region "), F.col("region").cast("string")), F.col("n")))
    return pages.segment_counts(lines, ["downloaddate"], "line", "sectors")


# Incremental loading


@query("stream_first_wins", "SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def stream_first_wins(t):
    def arrivals():
        return ingest.read_files(t.spark, t.folder, t.events.schema, "events.parquet")

    path = scratch_path(t.spark, "stream")
    twice = arrivals().union(arrivals())  # every file is sent twice
    ingest.first_wins_available(twice, f"{path}/rows", f"{path}/checkpoint", ["event_id"], ["ts", "user_id", "event_type", "value"])
    return t.spark.read.parquet(f"{path}/rows").select("event_id", "user_id", "event_type", "value")


@query("stream_first_wins_exact", "SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def stream_first_wins_exact(t):
    columns = ["event_id", "user_id", "event_type", "value"]
    arrivals = ingest.read_files(t.spark, t.folder, t.events.schema, "events.parquet").select(*columns)
    path = scratch_path(t.spark, "exact")
    ingest.first_wins_available(arrivals.union(arrivals), f"{path}/rows", f"{path}/checkpoint",
                                ["event_id"], ["user_id", "event_type", "value"])
    return t.spark.read.parquet(f"{path}/rows").select(*columns)


@query("stream_upsert", """SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_upsert(t):
    arrivals = ingest.read_files(t.spark, t.folder, t.events.schema, "events.parquet").select(
        "user_id", "ts", "event_id", "event_type", "value")
    path = scratch_path(t.spark, "upsert")
    ingest.upsert_available(arrivals, f"{path}/docs", f"{path}/checkpoint", "user_id", "ts", date(2024, 2, 1))
    return ingest.read_documents(t.spark, f"{path}/docs", "user_id").select("user_id", "event_id", "event_type", "value")


@query("stream_first_wins_state", "SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def stream_first_wins_state(t):
    path = scratch_path(t.spark, "state")
    incremental.first_wins_stateful(t.spark, t.folder, t.events.schema, "events.parquet", f"{path}/rows", f"{path}/checkpoint",
                                    ["event_id"], ["ts", "user_id", "event_type", "value"])
    return t.spark.read.parquet(f"{path}/rows").select("event_id", "user_id", "event_type", "value")


@query("stream_upsert_buckets", """SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_upsert_buckets(t):
    arrivals = ingest.read_files(t.spark, t.folder, t.events.schema, "events.parquet").select(
        "user_id", "ts", "event_id", "event_type", "value")
    path = scratch_path(t.spark, "buckets")
    incremental.upsert_by_bucket(arrivals, f"{path}/docs", f"{path}/checkpoint", "user_id", "ts", date(2024, 2, 1), buckets=16)
    incremental.compact_buckets(t.spark, f"{path}/docs", "user_id")
    return incremental.present_documents(t.spark, f"{path}/docs", "user_id").select("user_id", "event_id", "event_type", "value")

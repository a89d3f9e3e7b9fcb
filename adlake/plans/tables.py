"""Scans, sinks and upkeep of tables; projections and filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from adlake.functions import dates, text
from adlake.operators import combine, maintenance, worklist
from adlake.plans import roles
from adlake.plans.registry import TABLES, query
from adlake.plans.roles import COUNTS, DOCS, EVENTS_TODAY, LISTING, POSTINGS, SNAPSHOTS, TODAY
from adlake.session import scratch_path
from adlake.sources import tables
from adlake.sources.schemas import columns


@query("scan_listing", f"WITH {LISTING} SELECT * FROM listing")
def scan_listing(t):
    return roles.listing(t)


@query("table_row_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in TABLES))
def table_row_counts(t):
    return combine.row_counts({name: getattr(t, name) for name in TABLES})


@query("table_preview", f"""WITH {LISTING}
    SELECT DISTINCT * FROM listing WHERE country = 'ASIA' ORDER BY uid LIMIT 5""")
def table_preview(t):
    return combine.preview(roles.listing(t), "country", "ASIA", ["uid"], 5)


@query("csv_roundtrip", f"WITH {POSTINGS} SELECT * FROM postings")
def csv_roundtrip(t):
    ads = roles.postings(t)
    path = scratch_path(t.spark, "csv")
    tables.write_csv(ads, path)
    return tables.scan_csv(t.spark, path, ads.schema)


@query("lookup_csv", """SELECT p_name AS k, CAST(max(p_partkey) AS VARCHAR) AS v FROM part GROUP BY p_name""")
def lookup_csv(t):
    path = scratch_path(t.spark, "lookup")
    pairs = t.part.orderBy("p_partkey").select("p_name", F.col("p_partkey").cast("string"))
    pairs.write.option("header", False).csv(path)
    return tables.scan_lookup(t.spark, path)


@query("partition_overwrite", f"""WITH {LISTING}
    SELECT uid, postdate, stat, country FROM listing WHERE country NOT IN ('ASIA', 'EUROPE') UNION ALL
    SELECT uid, postdate, 'OPEN', country FROM listing WHERE country IN ('ASIA', 'EUROPE') AND stat <> 'CLOSED'""")
def partition_overwrite(t):
    path = scratch_path(t.spark, "partitions")
    ads = roles.listing(t).select("uid", "postdate", "stat", "country")
    tables.write_table(ads, path, ["country"])
    reloaded = ads.filter(F.col("country").isin("ASIA", "EUROPE") & (F.col("stat") != "CLOSED"))
    tables.refresh_partitions(reloaded.withColumn("stat", F.lit("OPEN")), path, ["country"])
    return t.spark.read.parquet(path)


@query("month_flush", f"""WITH {SNAPSHOTS}, gone AS (SELECT DISTINCT uid FROM snapshots
        WHERE stat = 'CLOSED' OR downloaddate < DATE '2001-08-01' - INTERVAL 90 DAY)
    SELECT uid, line, downloaddate, stat, quantity, 200108::INTEGER AS month
    FROM snapshots WHERE uid IN (SELECT uid FROM gone)""")
def month_flush(t):
    page = roles.snapshots(t).select("uid", "line", "downloaddate", "stat", "quantity")
    moved = maintenance.archive_moved(page, maintenance.gone_ads(page, TODAY, postdate="downloaddate"))
    path = scratch_path(t.spark, "archive")
    tables.flush_archive(moved, path, TODAY)
    return t.spark.read.parquet(path)


DOCUMENT_SCHEMA = ("event_id bigint, user_id bigint, event_type string, value double, "
                   "props struct<k:int>, error string")


@query("doc_scan", """SELECT event_id, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'error'""")
def doc_scan(t):
    docs = t.events.select("event_id", "user_id", "event_type", "value",
                           F.from_json("props", "k int").alias("props"),
                           F.when(F.col("event_type") == "error", "failed").alias("error"))
    path = scratch_path(t.spark, "docs")
    docs.write.json(path)  # a null error leaves no key
    found = tables.scan_documents(t.spark, path, DOCUMENT_SCHEMA)
    return found.select("event_id", "user_id", "event_type", "value", "props.k")


@query("raw_pages", "SELECT page_id, md5(html) AS digest, length(html) AS n_chars FROM pages")
def raw_pages(t):
    path = scratch_path(t.spark, "raw")
    tables.save_raw_pages(t.pages, path, date(2020, 1, 1))
    tables.save_raw_pages(t.pages, path, date(2020, 1, 1))  # a repeated run adds nothing
    raw = t.spark.read.parquet(path)
    return raw.select("page_id", F.md5("html").alias("digest"),
                      F.length("html").cast("long").alias("n_chars"))


MIGRATED = columns(
    "segment string, id bigint, name string, balance double, nation bigint, phone string")


@query("schema_migrate", """SELECT c_mktsegment AS segment, c_custkey AS id, c_name AS name,
    c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS phone
    FROM customer""")
def schema_migrate(t):
    return tables.migrate(t.customer, MIGRATED, {
        "c_mktsegment": "segment", "c_custkey": "id", "c_name": "name", "c_acctbal": "balance",
        "c_nationkey": "nation"})


FIRST_BATCH_UNTIL = date(1998, 1, 1)


@query("first_wins", f"""WITH {SNAPSHOTS} SELECT * FROM snapshots
    QUALIFY row_number() OVER (PARTITION BY uid, line
        ORDER BY downloaddate, stat, partkey, suppkey, quantity, price) = 1""")
def first_wins(t):
    rows, keys = roles.snapshots(t), ["uid", "line"]
    order = ["downloaddate", "stat", "partkey", "suppkey", "quantity", "price"]
    path = scratch_path(t.spark, "first_wins")
    for batch, arrived in enumerate([F.col("downloaddate") < F.lit(FIRST_BATCH_UNTIL),
                                     F.col("downloaddate") >= F.lit(FIRST_BATCH_UNTIL)]):
        stored = t.spark.read.parquet(path) if batch else None
        added = maintenance.first_wins(rows.filter(arrived), keys, order, old=stored)
        tables.write_table(added, f"{path}/batch={batch}")
    return t.spark.read.parquet(path).drop("batch")


@query("partition_refresh", f"""WITH {LISTING}
    SELECT * FROM listing WHERE country NOT IN ('ASIA', 'EUROPE') UNION ALL
    SELECT * REPLACE ('OPEN' AS stat) FROM listing
    WHERE country IN ('ASIA', 'EUROPE') AND stat <> 'CLOSED'""")
def partition_refresh(t):
    old = roles.listing(t)
    new = old.filter(F.col("stat") != "CLOSED").withColumn("stat", F.lit("OPEN"))
    return maintenance.refresh_partition(old, new, "country", ["ASIA", "EUROPE"])


@query("tombstone_delete", f"""WITH {LISTING} SELECT * FROM listing l
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l.uid)""")
def tombstone_delete(t):
    dead = roles.postings(t).filter(F.col("stat") == "CLOSED")
    return maintenance.remove_dead(roles.listing(t), dead, ["uid"])


@query("drop_error_docs", """SELECT event_id, event_type, value, CAST(NULL AS VARCHAR) AS error
    FROM events WHERE event_type <> 'error'""")
def drop_error_docs(t):
    docs = t.events.select("event_id", "event_type", "value",
                           F.when(F.col("event_type") == "error", "failed").alias("error"))
    return maintenance.drop_errors(docs)


UPSERT_NOW = date(1998, 7, 1)


@query("stale_upsert", f"""WITH {SNAPSHOTS},
    old AS (SELECT uid, max(downloaddate) AS downloaddate, 'stored' AS origin, count(*) AS lines
        FROM snapshots WHERE stat = 'CLOSED' GROUP BY uid),
    new AS (SELECT uid, max(downloaddate) AS downloaddate, 'loaded' AS origin, count(*) AS lines
        FROM snapshots WHERE stat <> 'CLOSED' GROUP BY uid)
    SELECT * FROM old WHERE downloaddate >= DATE '1998-06-01' OR uid NOT IN (SELECT uid FROM new)
    UNION ALL
    SELECT * FROM new WHERE uid NOT IN (SELECT uid FROM old WHERE downloaddate >= DATE '1998-06-01')""")
def stale_upsert(t):
    rows = roles.snapshots(t)

    def docs(part, origin):
        return part.groupBy("uid").agg(F.max("downloaddate").alias("downloaddate"),
                                       F.lit(origin).alias("origin"),
                                       F.count(F.lit(1)).alias("lines"))

    old = docs(rows.filter(F.col("stat") == "CLOSED"), "stored")
    new = docs(rows.filter(F.col("stat") != "CLOSED"), "loaded")
    return maintenance.stale_upsert(old, new, "uid", "downloaddate", UPSERT_NOW)


GONE = """gone AS (SELECT DISTINCT uid FROM snapshots
    WHERE stat = 'CLOSED' OR downloaddate < DATE '2001-08-01' - INTERVAL 90 DAY)"""


@query("archive_moved", f"""WITH {SNAPSHOTS}, {GONE}
    SELECT * FROM snapshots WHERE uid IN (SELECT uid FROM gone)""")
def archive_moved(t):
    page = roles.snapshots(t)
    return maintenance.archive_moved(
        page, maintenance.gone_ads(page, TODAY, postdate="downloaddate"))


@query("archive_live", f"""WITH {SNAPSHOTS}, {GONE}, {POSTINGS}
    SELECT * FROM postings WHERE uid NOT IN (SELECT uid FROM gone)
        AND uid NOT IN (SELECT uid FROM postings WHERE stat = 'CLOSED')""")
def archive_live(t):
    page, ads = roles.snapshots(t), roles.postings(t)
    gone = maintenance.gone_ads(page, TODAY, postdate="downloaddate")
    earlier = ads.filter(F.col("stat") == "CLOSED")  # archived in an earlier run
    return maintenance.archive_live(ads, [gone, earlier])


@query("archive_live_pages", f"""WITH {SNAPSHOTS}, {GONE}
    SELECT * FROM snapshots WHERE uid NOT IN (SELECT uid FROM gone)""")
def archive_live_pages(t):
    page = roles.snapshots(t)
    return maintenance.archive_live(
        page, [maintenance.gone_ads(page, TODAY, postdate="downloaddate")])


@query("status_dim", """WITH first_seen AS (
        SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r,
            ts, event_id FROM events),
    new AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS place FROM first_seen
        WHERE r = 1 AND event_type NOT IN ('purchase', 'hired'))
    SELECT 0::INTEGER AS id, 'purchase' AS jobstat UNION ALL SELECT 1, 'hired'
    UNION ALL SELECT CAST(place + 1 AS INTEGER), event_type FROM new""")
def status_dim(t):
    known = t.spark.createDataFrame([(0, "purchase"), (1, "hired")], "id int, jobstat string")
    return maintenance.extend_status_names(
        known, t.events, "event_type", ["ts", "event_id"], F.to_date("ts"))


@query("distinct_pairs", f"WITH {LISTING} SELECT DISTINCT country, category FROM listing")
def distinct_pairs(t):
    return roles.listing(t).select("country", "category").distinct()


@query("like_filter", "SELECT page_id, url FROM pages WHERE url LIKE '%page=%'")
def like_filter(t):
    return t.pages.select("page_id", "url").filter(F.col("url").like("%page=%"))


@query("complete_rows", f"""WITH {DOCS} SELECT * FROM docs
    WHERE lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def complete_rows(t):
    return combine.complete_rows(roles.docs_with_cache(t), ["lang", "quality", "toxic"])


@query("exclude_two", f"""WITH {LISTING},
    l AS (SELECT * REPLACE (nullif(level, '5-LOW') AS level) FROM listing)
    SELECT * FROM l WHERE category IS DISTINCT FROM 'HOUSEHOLD' AND level IS DISTINCT FROM '1-URGENT'""")
def exclude_two(t):
    ads = roles.listing(t).withColumn("level", text.sentinel_null(F.col("level"), "5-LOW"))
    return ads.filter(combine.differs(F.col("category"), "HOUSEHOLD")
                      & combine.differs(F.col("level"), "1-URGENT"))


@query("recent_days", """SELECT DISTINCT user_id, event_type FROM events
    WHERE ts >= DATE '2024-01-30' - INTERVAL 2 DAY""")
def recent_days(t):
    return worklist.recent_days(t.events, "ts", EVENTS_TODAY).select("user_id", "event_type").distinct()


WEEKLY = """SELECT uid, postdate, stat FROM postings
    WHERE date_diff('day', postdate, DATE '2001-08-01') BETWEEN 0 AND 7 * ({weeks} - 1)
        AND date_diff('day', postdate, DATE '2001-08-01') % 7 = 0"""


@query("weekly_rotation", f"WITH {POSTINGS} " + WEEKLY.format(weeks=15))
def weekly_rotation(t):
    due = worklist.weekly_rotation(t.orders, "o_orderdate", TODAY, 15)
    return due.select(F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("postdate"),
                      roles.status("o_orderstatus").alias("stat"))


@query("weekly_rotation_short", f"WITH {POSTINGS} " + WEEKLY.format(weeks=8))
def weekly_rotation_short(t):
    due = worklist.weekly_rotation(t.orders, "o_orderdate", TODAY, 8)
    return due.select(F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("postdate"),
                      roles.status("o_orderstatus").alias("stat"))


@query("shuffled_worklist", f"WITH {POSTINGS} SELECT uid, stat FROM postings")
def shuffled_worklist(t):
    return worklist.shuffled(roles.postings(t).select("uid", "stat"), "uid", seed=7)


@query("sentinel_null", f"""WITH {POSTINGS}
    SELECT uid, nullif(level, '4-NOT SPECIFIED') AS level,
        CASE WHEN stat <> 'NOT FOUND' THEN postdate END AS birth FROM postings""")
def sentinel_null(t):
    ads = roles.postings(t)
    birth = F.when(F.col("stat") == "NOT FOUND", "unknown").otherwise(F.col("postdate").cast("string"))
    return ads.select("uid", text.sentinel_null(F.col("level"), "4-NOT SPECIFIED").alias("level"),
                      dates.birth_date(birth).alias("birth"))


@query("union_live_archive", f"""WITH {POSTINGS}
    SELECT uid, postdate, level, compensation FROM postings WHERE stat <> 'CLOSED' UNION ALL
    SELECT uid, postdate, NULL, compensation FROM postings WHERE stat = 'CLOSED'""")
def union_live_archive(t):
    ads = roles.postings(t)
    live = ads.filter(F.col("stat") != "CLOSED").drop("stat")
    archived = ads.filter(F.col("stat") == "CLOSED").drop("stat", "level")
    return combine.union_tables(live, archived)


# Joins


@query("page_left_listing", """SELECT c.conv_id, c.turn, c.role, length(u.text) AS listed_chars
    FROM conversations c LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u
        ON c.conv_id = u.conv_id AND c.turn = u.turn""")
def page_left_listing(t):
    listed = t.conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.length("text").cast("long").alias("listed_chars"))
    return combine.left_with(t.conversations.select("conv_id", "turn", "role"), listed,
                             ["conv_id", "turn"])


@query("listing_left_page", f"""WITH {POSTINGS}, {SNAPSHOTS}
    SELECT p.uid, postdate, level, line, downloaddate, quantity
    FROM postings p LEFT JOIN snapshots s ON p.uid = s.uid""")
def listing_left_page(t):
    pages = roles.snapshots(t).select("uid", "line", "downloaddate", "quantity")
    return combine.left_with_many(roles.postings(t).select("uid", "postdate", "level"), pages, ["uid"])


LEVEL_NAMES = [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low")]


@query("map_or_keep", f"""WITH {POSTINGS}, lookup(k, v) AS (
    VALUES {", ".join(f"('{k}', '{v}')" for k, v in LEVEL_NAMES)})
    SELECT uid, coalesce(v, level) AS level FROM postings LEFT JOIN lookup ON level = k""")
def map_or_keep(t):
    lookup = t.spark.createDataFrame(LEVEL_NAMES, "k string, v string")
    return combine.map_or_keep(roles.postings(t).select("uid", "level"), "level", lookup)


CHANGED = """changed AS (SELECT DISTINCT a.region, a.sector
    FROM counts a JOIN counts b ON a.region = b.region AND a.sector = b.sector
        AND a.downloaddate = b.downloaddate + 2
    WHERE a.totalposts <> b.totalposts
        AND a.downloaddate + 5 >= (SELECT max(downloaddate) FROM counts))"""


@query("changed_segments", f"WITH {COUNTS}, {CHANGED} SELECT * FROM changed")
def changed_segments(t):
    return worklist.changed_segments(roles.counts(t), ["region", "sector"])


@query("segments_to_fetch", f"""WITH {COUNTS}, {CHANGED}
    SELECT * FROM changed UNION
    SELECT region, sector FROM counts c WHERE NOT EXISTS (SELECT 1 FROM counts p
        WHERE p.sector = 'purchase' AND p.region = c.region AND p.downloaddate = c.downloaddate)""")
def segments_to_fetch(t):
    counts = roles.counts(t)
    loaded = (t.events.filter(F.col("event_type") == "purchase")
              .select(F.col("user_id").alias("region"), F.to_date("ts").alias("downloaddate")).distinct())
    return worklist.segments_to_fetch(counts, loaded, ["region", "sector"], ["region", "downloaddate"])


@query("open_worklist", f"""WITH {LISTING}, {SNAPSHOTS}
    SELECT uid, postdate, country FROM listing WHERE uid NOT IN (SELECT uid FROM snapshots
        WHERE stat = 'CLOSED' OR downloaddate <= DATE '2001-08-01' - INTERVAL 93 DAY)""")
def open_worklist(t):
    page = roles.snapshots(t).withColumnRenamed("downloaddate", "postdate")
    return worklist.open_worklist(roles.listing(t).select("uid", "postdate", "country"), page, TODAY)


@query("unfetched_ads", f"""WITH {LISTING}, fetched AS (
        SELECT country, uid FROM listing JOIN lineitem ON uid = l_orderkey)
    SELECT DISTINCT country, uid FROM listing l WHERE NOT EXISTS (
        SELECT 1 FROM fetched f WHERE f.country = l.country AND f.uid = l.uid)""")
def unfetched_ads(t):
    ads = roles.listing(t).select("country", "uid")
    page = t.lineitem.select(F.col("l_orderkey").alias("uid"))
    return worklist.without(ads, worklist.within(ads, page, ["uid"]), ["country", "uid"]).distinct()


@query("untranslated_docs", """SELECT doc_id, lang FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def untranslated_docs(t):
    return worklist.without(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("double_anti", """SELECT doc_id, lang FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)
        AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def double_anti(t):
    # One anti join against the keys of both sides.
    known = combine.union_tables(t.labels.filter("quality = 1"), t.labels.filter("toxic = 1"))
    return worklist.without(t.documents.select("doc_id", "lang"), known, ["doc_id"])


@query("semi_in", f"""WITH {POSTINGS} SELECT uid, postdate, stat FROM postings
    WHERE uid IN (SELECT l_orderkey FROM lineitem)""")
def semi_in(t):
    page = t.lineitem.select(F.col("l_orderkey").alias("uid"))
    return worklist.within(roles.postings(t).select("uid", "postdate", "stat"), page, ["uid"])


@query("ids_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def ids_missing(t):
    have = t.pages.select(F.col("page_id").alias("doc_id"))
    return worklist.without(t.documents.select("doc_id"), have, ["doc_id"])


@query("latest_snapshot", f"""WITH {SNAPSHOTS} SELECT * FROM snapshots
    QUALIFY rank() OVER (PARTITION BY uid ORDER BY downloaddate DESC) = 1""")
def latest_snapshot(t):
    return combine.latest_snapshot(roles.snapshots(t), ["uid"], "downloaddate")


@query("links_left_docs", """SELECT l.doc_id, l.source, l.lang, quality, toxic
    FROM (SELECT DISTINCT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2', 'src3')) l
        LEFT JOIN labels d ON l.doc_id = d.doc_id""")
def links_left_docs(t):
    links = (t.documents.filter(F.col("source").isin("src1", "src2", "src3"))
             .select("doc_id", "source", "lang").distinct())
    return combine.left_with(links, t.labels, ["doc_id"])


REJECTED = "uid % 7 = 0 OR uid % 11 = 0"


@query("csv_good_rows", f"WITH {POSTINGS} SELECT * FROM postings WHERE NOT ({REJECTED})")
def csv_good_rows(t):
    """Every 7th line has a word for the amount, every 11th lacks its last column."""
    path = scratch_path(t.spark, "csv-rejects")
    ads = roles.postings(t).withColumn("compensation", F.when(F.col("uid") % 7 == 0, "none").otherwise(F.col("compensation").cast("string")))
    tables.write_csv(ads.filter("uid % 11 <> 0"), path)
    tables.write_csv(ads.filter("uid % 11 = 0").drop("compensation"), path, mode="append")
    good, _ = tables.scan_csv_checked(t.spark, path, roles.postings(t).schema)
    return good


@query("open_documents", "SELECT doc_id, lang, source, n_chars, 'kept' AS note FROM documents")
def open_documents(t):
    """Documents with a field that no schema declares, through load, store and upsert."""
    path = scratch_path(t.spark, "open")
    docs = t.documents.select("doc_id", "lang", "source", "n_chars", F.struct(F.lit("kept").alias("note")).alias("extra"))
    docs.select(F.to_json(F.struct("*"))).write.text(f"{path}/in")
    known = columns("doc_id bigint, lang string, source string")
    loaded = tables.scan_open_documents(t.spark, f"{path}/in", known)
    loaded.write.parquet(f"{path}/stored")
    stored = t.spark.read.parquet(f"{path}/stored")
    return stored.select("doc_id", "lang", "source", F.try_variant_get("document", "$.n_chars", "bigint").alias("n_chars"),
                         F.try_variant_get("document", "$.extra.note", "string").alias("note"))


@query("preview_by_partition", f"""WITH {LISTING}
    SELECT DISTINCT * FROM listing WHERE country = 'ASIA' ORDER BY uid LIMIT 5""")
def preview_by_partition(t):
    path = scratch_path(t.spark, "layout")
    ads = roles.listing(t)
    tables.write_table(ads.withColumn("month", F.date_format("postdate", "yyyyMM")), path, ["country", "month"])
    return combine.preview(t.spark.read.parquet(path).select(*ads.columns), "country", "ASIA", ["uid"], 5)

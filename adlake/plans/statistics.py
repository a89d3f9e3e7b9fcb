"""Counts, availability, means, trends and top lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from adlake.functions import dates
from adlake.functions.features import equals_flag
from adlake.operators import combine, month_store, stats, terms, trends, worklist
from adlake.plans import roles
from adlake.plans.registry import query
from adlake.plans.roles import COUNTS, DOCS, LISTING, MONTHS, MULTICAT, POSTINGS, TODAY
from adlake.session import scratch_path


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("count_by_two", f"""WITH {LISTING} SELECT country, category, count(uid) AS cnt FROM listing
    WHERE category IN ('MACHINERY', 'BUILDING', 'FURNITURE') GROUP BY country, category""")
def count_by_two(t):
    ads = roles.listing(t).filter(F.col("category").isin("MACHINERY", "BUILDING", "FURNITURE"))
    return stats.count_by(ads, ["country", "category"], "uid")


def countries(t):
    """All countries, and one without ads."""
    return t.region.select(F.col("r_name").alias("country")).union(
        t.spark.createDataFrame([("ANTARCTICA",)], "country string"))


COUNTRIES = "countries AS (SELECT r_name AS country FROM region UNION ALL SELECT 'ANTARCTICA')"


@query("high_water", f"""WITH {LISTING}, {COUNTRIES}
    SELECT c.country, coalesce(max(postdate), DATE '2001-08-01' - 29)::DATE AS mark
    FROM countries c LEFT JOIN listing l ON c.country = l.country GROUP BY c.country""")
def high_water(t):
    return worklist.high_water(countries(t), roles.listing(t), ["country"], "postdate", TODAY)


RELOAD_DAY = date(2001, 8, 7)


@query("stale_countries", f"""WITH {LISTING}, {COUNTRIES},
    lasts AS (SELECT c.country, max(postdate) AS last
        FROM countries c LEFT JOIN listing l ON c.country = l.country GROUP BY c.country)
    SELECT * FROM lasts WHERE last IS NULL OR date_diff('day', last, DATE '2001-08-07') >= 7""")
def stale_countries(t):
    return worklist.stale_groups(countries(t), roles.listing(t), ["country"], "postdate", RELOAD_DAY, 7)


@query("since_mark", f"""WITH {LISTING}, marks AS (
        SELECT country, max(postdate) AS mark FROM listing WHERE stat = 'NOT FOUND' AND country <> 'ASIA' GROUP BY country)
    SELECT l.* FROM listing l LEFT JOIN marks m ON l.country = m.country
    WHERE postdate >= coalesce(mark, DATE '1998-08-01' - 29)""")
def since_mark(t):
    ads = roles.listing(t)
    # Pages that were not found set the marks; one country has none and starts at the default.
    missed = ads.filter((F.col("stat") == "NOT FOUND") & (F.col("country") != "ASIA"))
    marks = missed.groupBy("country").agg(F.max("postdate").alias("mark"))
    return worklist.since_mark(ads, marks, ["country"], "postdate", date(1998, 8, 1))


@query("cats_per_ad", f"""WITH {MULTICAT} SELECT country, uid, count(*) AS cats
    FROM (SELECT DISTINCT country, uid, cat FROM multicat) GROUP BY country, uid""")
def cats_per_ad(t):
    return trends.cats_per_ad(roles.multicat(t))


@query("weighted_counts", f"WITH {MONTHS} SELECT country, cat, round(total, 6) AS total FROM totals")
def weighted_counts(t):
    return rounded(trends.category_totals(trends.category_months(roles.multicat(t))), "total")


@query("weighted_counts_loads", f"WITH {MONTHS} SELECT country, cat, round(total, 6) AS total FROM totals")
def weighted_counts_loads(t):
    """As ``weighted_counts``, in three loads by date: many ads gain a category in a later one."""
    path = scratch_path(t.spark, "months")
    ads = roles.multicat(t)
    cuts = [date(1994, 1, 1), date(1997, 1, 1)]
    parts = [F.col("postdate") < cuts[0], (F.col("postdate") >= cuts[0]) & (F.col("postdate") < cuts[1]),
             F.coalesce(F.col("postdate") >= cuts[1], F.lit(True))]
    for version, part in enumerate(parts):
        month_store.load(ads.filter(part), path, version, buckets=16)
    return rounded(trends.category_totals(month_store.category_months(t.spark, path)), "total")


@query("weighted_counts_whole", f"""WITH {MONTHS} SELECT s.country, s.cat,
        sum(CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0 END) AS total
    FROM seen s JOIN cats c ON s.country = c.country AND s.uid = c.uid GROUP BY s.country, s.cat""")
def weighted_counts_whole(t):
    return trends.category_totals(trends.category_months(roles.multicat(t), whole=True))


@query("weighted_monthly", f"""WITH {MONTHS}
    SELECT country, month, cat, round(total, 6) AS total FROM months WHERE month IS NOT NULL""")
def weighted_monthly(t):
    return rounded(trends.dated(trends.category_months(roles.multicat(t))), "total")


@query("country_totals", f"""WITH {MONTHS}
    SELECT country, round(sum(total), 6) AS total FROM months GROUP BY country""")
def country_totals(t):
    return rounded(trends.country_totals(trends.category_months(roles.multicat(t))), "total")


@query("top5_categories", f"""WITH {MONTHS}
    SELECT country, cat, round(total, 6) AS total, CAST(place AS INTEGER) AS place
    FROM placed WHERE place <= 5""")
def top5_categories(t):
    return rounded(trends.top_categories(trends.category_months(roles.multicat(t)), 5), "total")


@query("top5_share", f"""WITH {MONTHS}, top AS (
        SELECT m.country, sum(m.total) AS total FROM months m JOIN placed p
            ON m.country = p.country AND m.cat = p.cat
        WHERE place <= 5 AND month IS NOT NULL GROUP BY m.country)
    SELECT a.country, CAST(floor(round(100 * any_value(top.total) / sum(a.total), 6)) AS INTEGER)
        AS top_pct
    FROM totals a JOIN top ON a.country = top.country GROUP BY a.country""")
def top5_share(t):
    return trends.top_share(trends.category_months(roles.multicat(t)), 5)


SPAN = """span AS (SELECT m.country, min(month) AS first_month, max(month) AS last_month
    FROM months m JOIN placed p ON m.country = p.country AND m.cat = p.cat
    WHERE place <= 5 AND month IS NOT NULL GROUP BY m.country)"""


@query("first_last_month", f"WITH {MONTHS}, {SPAN} SELECT * FROM span")
def first_last_month(t):
    return trends.month_span(trends.category_months(roles.multicat(t)), 5)


@query("category_change", f"""WITH {MONTHS}, {SPAN}, changes AS (
        SELECT m.country, m.cat, sum(total) FILTER (month = last_month)
            - sum(total) FILTER (month = first_month) AS change
        FROM months m JOIN span s ON m.country = s.country GROUP BY m.country, m.cat),
    ranked AS (SELECT country, cat, round(change, 6) AS change,
        CAST(row_number() OVER (PARTITION BY country ORDER BY round(change, 9), cat) AS INTEGER) AS lowest,
        CAST(row_number() OVER (PARTITION BY country ORDER BY round(change, 9) DESC, cat) AS INTEGER)
            AS highest FROM changes WHERE change IS NOT NULL)
    SELECT * FROM ranked WHERE lowest <= 2 OR highest <= 2""")
def category_change(t):
    return rounded(trends.category_change(trends.category_months(roles.multicat(t)), 2, 5), "change")


CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("pivot_month_cat", f"WITH {MONTHS} SELECT country, month, " + ", ".join(
    f"round(sum(total) FILTER (cat = '{c}'), 6) AS \"{c}\"" for c in CATEGORIES)
    + ", round(sum(total) FILTER (cat IS NULL OR cat NOT IN (" + ", ".join(f"'{c}'" for c in CATEGORIES)
    + ")), 6) AS other FROM months WHERE month IS NOT NULL GROUP BY country, month")
def pivot_month_cat(t):
    pivoted = trends.pivot_months(trends.category_months(roles.multicat(t)), CATEGORIES)
    return rounded(pivoted, *CATEGORIES, "other")


def cents(c):
    return F.round(c * 100).cast("bigint")


@query("summary_stats", f"""WITH {LISTING},
    l AS (SELECT * REPLACE (nullif(category, 'HOUSEHOLD') AS category),
        CASE WHEN stat <> 'NOT FOUND' THEN CAST(round(compensation * 100) AS BIGINT) END AS cents FROM listing)
    SELECT country, category, count(uid) AS ads, avg(cents) AS cents,
        avg(CAST(stat = 'CLOSED' AS INTEGER)) AS closed
    FROM l WHERE country IS NOT NULL AND category IS NOT NULL GROUP BY country, category""")
def summary_stats(t):
    ads = roles.listing(t).withColumns({
        "category": F.nullif("category", F.lit("HOUSEHOLD")),
        "cents": F.when(F.col("stat") != "NOT FOUND", cents(F.col("compensation"))),
        "closed": equals_flag(F.col("stat"), "CLOSED")})
    return stats.summary_stats(ads, ["country", "category"], "uid", ["cents", "closed"])


DOC_COLUMNS = ["lang", "source", "n_chars", "quality", "toxic"]


def availability(test: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(avg(CASE WHEN {c} {test} THEN 100.0::DOUBLE ELSE 0 END), 6)"
        f" AS pct FROM docs" for c in DOC_COLUMNS)


@query("missing_pct", f"WITH {DOCS} " + availability("IS NULL"))
def missing_pct(t):
    return rounded(stats.missing_pct(roles.docs_with_cache(t), DOC_COLUMNS), "pct")


@query("available_pct", f"WITH {DOCS} " + availability("IS NOT NULL"))
def available_pct(t):
    return rounded(stats.available_pct(roles.docs_with_cache(t), DOC_COLUMNS), "pct")


@query("available_by_group", f"WITH {DOCS} " + " UNION ALL ".join(
    f"SELECT lang, count(*) AS n, '{c}' AS variable,"
    f" round(avg(CASE WHEN {c} IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct"
    f" FROM docs GROUP BY lang HAVING count(*) > 110" for c in ["source", "quality", "toxic"]))
def available_by_group(t):
    return rounded(stats.available_by_group(
        roles.docs_with_cache(t), "lang", ["source", "quality", "toxic"], 110), "pct")


@query("value_counts", f"WITH {LISTING}, l AS (SELECT * REPLACE (nullif(level, '5-LOW') AS level) FROM listing) "
       + " UNION ALL ".join(
           f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM l WHERE {c} IS NOT NULL GROUP BY {c}"
           for c in ["stat", "category", "level", "country"]))
def value_counts(t):
    ads = roles.listing(t).withColumn("level", F.nullif("level", F.lit("5-LOW")))
    return stats.value_counts(ads, ["stat", "category", "level", "country"])


FREQUENT = ["l_returnflag", "l_linestatus", "l_quantity", "l_partkey", "l_orderkey"]


@query("frequent_values", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST(v AS VARCHAR) AS value, n, n::DOUBLE / (SELECT count(*) FROM lineitem) AS share"
    f" FROM (SELECT {c if 'quantity' not in c else c + '::BIGINT'} AS v, count(*) AS n FROM lineitem GROUP BY 1)"
    f" WHERE n::DOUBLE / (SELECT count(*) FROM lineitem) >= 0.02" for c in FREQUENT))
def frequent_values(t):
    return stats.frequent_values(t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("long")), FREQUENT, 0.02)


@query("share_of_total", """SELECT lang, source, count(*) AS n,
        round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 9) AS share
    FROM documents d WHERE (SELECT count(*) FROM documents g WHERE g.lang = d.lang) > 100
    GROUP BY lang, source""")
def share_of_total(t):
    return rounded(stats.value_share(t.documents, "lang", "source", 100), "share", places=9)


@query("share_of_group", """SELECT lang, source, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang), 9) AS share
    FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)""")
def share_of_group(t):
    return rounded(stats.value_share(t.documents, "lang", "source", denominator="group"), "share",
                   places=9)


@query("active_within", f"""WITH {POSTINGS}, ages AS (
        SELECT coalesce((2001 - year(d)) * 12 + 8 - month(d), -1) AS age
        FROM (SELECT CASE WHEN stat <> 'NOT FOUND' THEN postdate END AS d FROM postings)) """
       + " UNION ALL ".join(
           f"SELECT {m}::INTEGER AS months, round(avg(CASE WHEN age BETWEEN 0 AND {m} THEN 1.0::DOUBLE"
           f" ELSE 0 END), 9) AS share FROM ages" for m in (1, 3, 6, 12)))
def active_within(t):
    users = roles.postings(t).withColumn(
        "last_active", F.when(F.col("stat") != "NOT FOUND", F.col("postdate")))
    return rounded(stats.active_within(users, "last_active", TODAY), "share", places=9)


@query("mean_std", f"""WITH {LISTING}, users AS (
        SELECT country, floor(date_diff('day', postdate, DATE '2001-08-01') / 365) AS age,
            CAST(level = '1-URGENT' AS INTEGER) AS female, CAST(stat = 'OPEN' AS INTEGER) AS employed
        FROM listing)
    SELECT country, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_std,
        round(avg(female), 6) AS female, round(avg(employed), 6) AS employed
    FROM users GROUP BY country""")
def mean_std(t):
    users = roles.listing(t).select(
        "country", dates.age_years(F.col("postdate"), TODAY).alias("age"),
        equals_flag(F.col("level"), "1-URGENT").alias("female"),
        equals_flag(F.concat(F.lit(" "), F.col("stat"), F.lit(" ")), "OPEN").alias("employed"))
    table = stats.mean_std(users, "country", ["age"], ["female", "employed"])
    return rounded(table, "age_mean", "age_std", "female", "employed")


@query("user_stats", """WITH users AS (SELECT doc_id, 'Female' AS gender, quality, DATE '1980-01-01' + toxic * 3000 AS birth
        FROM labels), found AS (
    SELECT lang AS country, floor(date_diff('day', birth, DATE '2001-08-01') / 365) AS age,
        CAST(gender IS NOT NULL AS INTEGER) AS female, CAST(coalesce(quality = 1, false) AS INTEGER) AS employed
    FROM documents d LEFT JOIN users u ON d.doc_id = u.doc_id)
    SELECT country, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_std,
        round(avg(female), 6) AS female, round(avg(employed), 6) AS employed FROM found GROUP BY country""")
def user_stats(t):
    links = t.documents.select(F.col("lang").alias("country"), "doc_id")
    users = t.labels.select(
        "doc_id", F.lit("Female ").alias("gender"), F.when(F.col("quality") == 1, "working").alias("jobstatus"),
        F.date_add(F.lit(date(1980, 1, 1)), F.col("toxic") * 3000).alias("birth_date"))
    table = stats.user_stats(links, users, "doc_id", TODAY, employed="working")
    return rounded(table, "age_mean", "age_std", "female", "employed")


RUN_DAY = date(2024, 1, 29)


@query("new_entries", """SELECT user_id AS region, event_type AS sector,
        count(*) FILTER (ts < DATE '2024-01-29') AS old_entries, count(*) AS new_entries,
        count(*) FILTER (ts >= DATE '2024-01-29') AS added FROM events GROUP BY ALL""")
def new_entries(t):
    after = t.events.select(F.col("user_id").alias("region"), F.col("event_type").alias("sector"), "ts")
    before = after.filter(F.col("ts") < F.lit(RUN_DAY))
    return worklist.new_entries(before, after, ["region", "sector"])


KEYWORDS = ["that", "with", "from", "license", "released", "und", "les", "para"]


@query("keyword_totals", f"""WITH words AS (
        SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS keyword
        FROM (SELECT DISTINCT source, text FROM documents))
    SELECT keyword, count(*) AS n FROM words
    WHERE keyword IN ({", ".join(f"'{k}'" for k in KEYWORDS)}) GROUP BY keyword""")
def keyword_totals(t):
    return terms.keyword_totals(roles.texts(t), ["source"], "text", KEYWORDS)


@query("daily_profile", f"""WITH {POSTINGS} SELECT postdate, count(cents) AS cents_count,
        avg(cents) AS cents_mean, round(stddev_samp(cents), 2) AS cents_std,
        count(closed) AS closed_count, avg(closed) AS closed_mean, round(stddev_samp(closed), 6) AS closed_std
    FROM (SELECT *, CAST(round(compensation * 100) AS BIGINT) AS cents,
        CAST(stat = 'CLOSED' AS INTEGER) AS closed FROM postings) GROUP BY postdate""")
def daily_profile(t):
    # Whole cents: their sum, and so their mean, does not depend on the order of the rows.
    ads = roles.postings(t).withColumns({
        "cents": cents(F.col("compensation")), "closed": equals_flag(F.col("stat"), "CLOSED")})
    table = stats.profile_by(ads, "postdate", ["cents", "closed"])
    return rounded(rounded(table, "cents_std", places=2), "closed_std")


@query("top_n", f"WITH {POSTINGS} SELECT * FROM postings ORDER BY compensation DESC, uid LIMIT 10")
def top_n(t):
    return combine.top_n(roles.postings(t), 10, F.desc("compensation"), "uid")


@query("segment_days", f"WITH {COUNTS} SELECT * FROM counts")
def segment_days(t):
    return roles.counts(t)

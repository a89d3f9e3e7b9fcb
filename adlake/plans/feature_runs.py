"""The feature runs of both job sites over the given tables, with the default rule lists."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from adlake import rules, runs
from adlake.plans import roles
from adlake.plans.features import sql_list, whole_word_sql
from adlake.plans.registry import query
from adlake.plans.roles import LISTING, TODAY
from adlake.session import scratch_path
from adlake.sources import tables
from adlake.sources.schemas import SCHEMAS

# Line items are the page snapshots of an ad (an order).

LEVELS = ["BachelorsDegree", "MastersDegree", "PhD", "HighSchool"]
EMPLOY = {"R": "Full-time", "A": "Part-time"}
EXPERIENCE = ["Entry level", "Management", "Mid-level"]

SITE = f"""{LISTING}, pages AS (
    SELECT l_orderkey AS uid, CAST(l_shipdate AS DATE) AS downloaddate, CAST(l_quantity AS INTEGER) AS pageviews,
        CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS compensation,
        [{sql_list(LEVELS)}][l_suppkey % 4 + 1] AS educationlevel,
        CASE l_returnflag {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EMPLOY.items())} END AS employtype,
        [{sql_list(EXPERIENCE)}][l_partkey % 3 + 1] AS experiencelevel FROM lineitem),
latest AS (SELECT * FROM pages QUALIFY rank() OVER (PARTITION BY uid ORDER BY downloaddate DESC) = 1),
ads AS (SELECT p.*, l.country, l.category, l.postdate FROM latest p JOIN listing l ON p.uid = l.uid
    WHERE l.category <> 'BUILDING')"""


def _flag(name: str) -> str:
    column, values = rules.MEMBER_FLAGS[name]
    return f"avg(CAST(coalesce({column} IN ({sql_list(values)}), false) AS INTEGER)) AS {name}"


@query("classified_run", f"""WITH {SITE}
    SELECT country, category AS jobsector, count(*) AS ads, avg(date_diff('day', postdate, downloaddate)) AS daysposted,
        avg(compensation) AS compensation, avg(pageviews) AS pageviews,
        {", ".join(_flag(name) for name in rules.MEMBER_FLAGS)} FROM ads GROUP BY country, category""")
def classified_run(t):
    def pick(values, n):
        return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))

    ads = roles.listing(t).select("country", F.col("category").alias("jobsector"), "postdate", "uid")
    home = ads.select("uid", "country", "postdate")
    line = t.lineitem.select(
        F.col("l_orderkey").alias("uid"), F.col("l_shipdate").cast("date").alias("downloaddate"),
        F.col("l_quantity").cast("int").alias("pageviews"),
        pick(LEVELS, F.col("l_suppkey") % 4).alias("educationlevel"), pick(EXPERIENCE, F.col("l_partkey") % 3).alias("experiencelevel"),
        F.when(F.col("l_returnflag") == "R", EMPLOY["R"]).when(F.col("l_returnflag") == "A", EMPLOY["A"]).alias("employtype"),
        (F.floor("l_extendedprice") % 2000).alias("compensation"))
    page = line.join(home, "uid").to(SCHEMAS["page"])
    made = runs.classified_features(ads.to(SCHEMAS["listing"]), page, scratch_path(t.spark, "classified"), exclude=["BUILDING"])
    return made["summary"].select("country", "jobsector", "ads", "daysposted", "compensation", "pageviews", *rules.MEMBER_FLAGS)


# Parts are the ads of the board.

NEEDS = ["Bachelor degree>Good English", "M.B.A. or masters>Travel>Sales", "BSc. of Science", "Ph.D", "High school", "Nothing"]
PLACES = ["Maadi, Cairo", "Giza, Egypt", "Port Said", "Luxor", "Kafr Alsheikh, Egypt"]
KINDS = {"STANDARD": "'IT']>Sales", "PROMO": "Sales"}

NEED = f"[{sql_list(NEEDS)}][p_partkey % {len(NEEDS)} + 1]"
PLACE = f"[{sql_list(PLACES)}][p_size % {len(PLACES)} + 1]"


@query("board_run", f"""SELECT p_partkey AS uid, CASE WHEN p_size > 40 THEN p_size ELSE 0 END AS expmin,
        p_size AS vacancies, CAST(len(string_split({NEED}, '>')) AS INTEGER) AS req_num,
        CAST(contains(lower({NEED}), 'bachelor') AS INTEGER) AS req_bachelors,
        coalesce(nullif(regexp_extract({PLACE}, '({"|".join(rules.PROVINCES)})', 1), ''), 'Other') AS province,
        CASE {" ".join(f"WHEN {whole_word_sql(f'lower({NEED})', '|'.join(v))} THEN '{k}'" for k, v in rules.EDUCATION_TERMS.items())}
            END AS education_level,
        CASE p_type WHEN 'STANDARD' THEN 'IT' WHEN 'PROMO' THEN 'Sales' END AS ind0,
        CASE p_type WHEN 'STANDARD' THEN 'Sales' END AS ind1 FROM part""")
def board_run(t):
    def pick(values, n):
        return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))

    years = F.when(F.col("p_size") > 40, F.concat("p_size", F.lit(" years"))).otherwise(F.concat(F.lit("Less than "), "p_size", F.lit(" years")))
    page = t.part.select(
        F.lit("egypt").alias("country"), F.col("p_partkey").alias("uid"), F.lit("2020-01-01").cast("date").alias("postdate"),
        F.lit("2020-01-05").cast("date").alias("downloaddate"), years.alias("experience_needed"),
        F.concat("p_size", F.lit(" open positions")).alias("vacancies"), pick(NEEDS, F.col("p_partkey") % len(NEEDS)).alias("requirements"),
        pick(PLACES, F.col("p_size") % len(PLACES)).alias("location"), F.col("p_brand").alias("company"),
        F.when(F.col("p_type") == "STANDARD", KINDS["STANDARD"]).when(F.col("p_type") == "PROMO", KINDS["PROMO"]).alias("industries"))
    names = t.part.select(F.col("p_brand").alias("k"), F.lower("p_brand").alias("v")).distinct()
    made = runs.board_features(page.select("country", "uid", "postdate").to(SCHEMAS["job_listing"]), page.to(SCHEMAS["job_page"]),
                               scratch_path(t.spark, "board"), names)
    return made["features"].select("uid", "expmin", "vacancies", "req_num", "req_bachelors", "province", "education_level", "ind0", "ind1")


# The archive of the stored tables, in place: orders are the listing, line items its pages.

ARCHIVE_DAYS = 2000   # the given dates are old

OVER = f"""over AS (SELECT DISTINCT l_orderkey AS uid FROM lineitem
    WHERE l_linestatus = 'F' AND l_returnflag = 'R' OR CAST(l_shipdate AS DATE) < DATE '{TODAY - timedelta(days=ARCHIVE_DAYS)}')"""


@query("archive_in_place", f"""WITH {LISTING}, {OVER}, pages AS (
        SELECT l_orderkey AS uid, country, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN listing ON l_orderkey = uid)
    SELECT 'page' AS kept_in, country, uid, day FROM pages WHERE uid NOT IN (SELECT uid FROM over) UNION ALL
    SELECT 'archive', country, uid, day FROM pages WHERE uid IN (SELECT uid FROM over) UNION ALL
    SELECT 'listing', country, uid, postdate FROM listing WHERE uid NOT IN (SELECT uid FROM over)""")
def archive_in_place(t):
    ads = roles.listing(t).select("country", F.col("category").alias("jobsector"), "postdate", "uid")
    line = t.lineitem.select(
        F.col("l_orderkey").alias("uid"), F.col("l_shipdate").cast("date").alias("downloaddate"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "CLOSED").otherwise("OPEN").alias("stat"),
        F.col("l_shipdate").cast("date").alias("postdate"))
    path = scratch_path(t.spark, "in-place")
    tables.write_table(ads.to(SCHEMAS["listing"]), f"{path}/listing", ["country"])
    tables.write_table(line.join(ads.select("uid", "country"), "uid").to(SCHEMAS["page"]), f"{path}/page", ["country"])
    runs.archive_run(t.spark, f"{path}/page", f"{path}/listing", f"{path}/archive", f"{path}/work", TODAY, max_days=ARCHIVE_DAYS)

    def of(name, day):
        return t.spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("kept_in"), "country", "uid", F.col(day).alias("day"))

    return of("page", "downloaddate").unionByName(of("archive", "downloaddate")).unionByName(of("listing", "postdate"))

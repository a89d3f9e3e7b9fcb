"""The given tables in the roles of ad listings, pages, counts and resumes.

Each role is a DataFrame function and, for the SQL side, a common table expression.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake.plans.registry import Tables
from adlake.sources.tables import spread, tasks_for

TODAY = date(2001, 8, 1)
EVENTS_TODAY = date(2024, 1, 30)

STAT_SQL = "CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'NOT FOUND' END"


def status(c: str):
    return F.when(F.col(c) == "F", "CLOSED").when(F.col(c) == "O", "OPEN").otherwise("NOT FOUND")


def places(t: Tables) -> DataFrame:
    """Customers with nation and region names; the two name tables are of fixed size."""
    return (t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))


def listing(t: Tables) -> DataFrame:
    """One row per ad."""
    return t.orders.join(places(t), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderdate").cast("date").alias("postdate"),
        status("o_orderstatus").alias("stat"), F.col("r_name").alias("country"),
        F.col("n_name").alias("region"), F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("level"), F.col("o_totalprice").alias("compensation"))


LISTING = f"""listing AS (
    SELECT o_orderkey AS uid, CAST(o_orderdate AS DATE) AS postdate, {STAT_SQL} AS stat,
        r_name AS country, n_name AS region, c_mktsegment AS category,
        o_orderpriority AS level, o_totalprice AS compensation
    FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def postings(t: Tables) -> DataFrame:
    """Ads without their place: for operators that need none, so no join is run."""
    return t.orders.select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderdate").cast("date").alias("postdate"),
        status("o_orderstatus").alias("stat"), F.col("o_orderpriority").alias("level"),
        F.col("o_totalprice").alias("compensation"))


POSTINGS = f"""postings AS (
    SELECT o_orderkey AS uid, CAST(o_orderdate AS DATE) AS postdate, {STAT_SQL} AS stat,
        o_orderpriority AS level, o_totalprice AS compensation FROM orders)"""


def multicat(t: Tables) -> DataFrame:
    """Ads in several categories: country, uid, cat, postdate.

    The rows are made distinct before the country is joined on: an ad with very many
    rows is cut down first and does not make the join lopsided. Of many line items neither the
    distinct nor what is grouped by ad after it is left to the session's number of tasks: they run in
    as many as the line items need. Repeats are dealt out by the task they come from too, so that
    very many of one row are cut down in several tasks before they meet.
    """
    seen = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("uid"), F.col("p_type").alias("cat"),
                    F.col("l_shipdate").cast("date").alias("postdate")))
    home = t.orders.join(places(t), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("uid"), F.col("r_name").alias("country"))
    tasks = tasks_for(t.lineitem)
    if tasks:
        dealt = seen.withColumn("_from", F.spark_partition_id()).repartition(tasks, "uid", "cat", "postdate", "_from")
        seen, home = dealt.distinct().drop("_from").repartition(tasks, "uid"), home.repartition(tasks, "uid")
    return seen.distinct().join(home, "uid").select("country", "uid", "cat", "postdate")


MULTICAT = """multicat AS (
    SELECT r_name AS country, l_orderkey AS uid, p_type AS cat, CAST(l_shipdate AS DATE) AS postdate
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)"""

MONTHS = MULTICAT + """,
seen AS (SELECT DISTINCT date_trunc('month', postdate)::DATE AS month, country, uid, cat FROM multicat),
cats AS (SELECT country, uid, count(*) AS k
    FROM (SELECT DISTINCT country, uid, cat FROM multicat) GROUP BY country, uid),
months AS (SELECT s.country, s.month, s.cat, sum(1.0::DOUBLE / k) AS total
    FROM seen s LEFT JOIN cats c ON s.country = c.country AND s.uid = c.uid
    GROUP BY s.country, s.month, s.cat),
totals AS (SELECT country, cat, sum(total) AS total FROM months GROUP BY country, cat),
placed AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY round(total, 9) DESC, cat)
    AS place FROM totals)"""


def snapshots(t: Tables) -> DataFrame:
    """Repeated page downloads."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").cast("date").alias("downloaddate"),
        status("l_linestatus").alias("stat"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"))


SNAPSHOTS = """snapshots AS (
    SELECT l_orderkey AS uid, l_linenumber AS line, CAST(l_shipdate AS DATE) AS downloaddate,
        CASE l_linestatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'NOT FOUND' END AS stat,
        l_partkey AS partkey, l_suppkey AS suppkey, l_quantity AS quantity,
        l_extendedprice AS price FROM lineitem)"""


def counts(t: Tables) -> DataFrame:
    """Ads per region, sector and day."""
    return (t.events.groupBy(F.col("user_id").alias("region"), F.col("event_type").alias("sector"),
                             F.col("ts").cast("date").alias("downloaddate"))
            .agg(F.count(F.lit(1)).alias("totalposts")))


COUNTS = """counts AS (
    SELECT user_id AS region, event_type AS sector, CAST(ts AS DATE) AS downloaddate,
        count(*) AS totalposts FROM events GROUP BY ALL)"""


def texts(t: Tables) -> DataFrame:
    """Descriptions for work that is heavy per text."""
    return spread(t.documents)


def docs_with_cache(t: Tables) -> DataFrame:
    """Descriptions with what is known of them."""
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    return docs.join(t.labels, ["doc_id"], "left")


DOCS = """docs AS (
    SELECT d.doc_id, lang, source, n_chars, quality, toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

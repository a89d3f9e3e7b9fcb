"""Work that must not grow faster than its table: partitions by row count, phrases before their join, unescaping in steps."""

import html

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adlake.functions import text
from adlake.operators import rule_table, trends
from adlake.plans import catalog, roles
from adlake.plans.registry import Tables
from adlake.sources import tables


def test_many_line_items_are_grouped_in_more_tasks(spark, sf_dir, monkeypatch):
    t = Tables(spark, sf_dir)
    before = sorted(map(tuple, trends.category_months(roles.multicat(t)).withColumn("total", F.round("total", 6)).collect()))
    monkeypatch.setattr(roles, "tasks_for", lambda scan: tables.tasks_for(scan, 500))
    ads = roles.multicat(t)
    tasks = -(-t.lineitem.count() // 500)
    plan = trends.ad_weights(ads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"hashpartitioning(uid#") >= 2 and f", {tasks}), REPARTITION_BY_NUM" in plan
    after = sorted(map(tuple, trends.category_months(ads).withColumn("total", F.round("total", 6)).collect()))
    assert after == before and len(after) > 0


def test_many_line_items_are_made_distinct_in_more_tasks(spark, sf_dir, monkeypatch):
    """No map of what is seen is kept by a task of the scan, nor by one of the session's few."""
    t = Tables(spark, sf_dir)
    monkeypatch.setattr(roles, "tasks_for", lambda scan: tables.tasks_for(scan, 500))
    tasks = -(-t.lineitem.count() // 500)
    plan = roles.multicat(t)._jdf.queryExecution().executedPlan().toString().splitlines()
    aggregates = [i for i, line in enumerate(plan) if "HashAggregate(" in line]
    dealt = [i for i, line in enumerate(plan) if "hashpartitioning(" in line and f", {tasks}), REPARTITION_BY_NUM" in line]
    assert len(dealt) == 3 and "_from#" in plan[dealt[1]]
    assert aggregates and max(aggregates) < dealt[1]  # plans are printed from the end: nothing is grouped before it is dealt out
    assert not any("Exchange" in line for line in plan[min(aggregates):dealt[1]] if f", {tasks})" not in line)


def test_repeats_dealt_out_by_their_task_meet_again(spark, tmp_path, monkeypatch):
    """Rows that come very many times and in all tasks, null keys, and ads without an order."""
    lines = spark.range(6_000, numPartitions=6).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 1 WHEN id % 97 = 0 THEN NULL ELSE id % 40 END AS l_orderkey", "IF(id % 2 = 0, 1, id % 7) AS l_partkey",
        "IF(id % 2 = 0, DATE '2020-01-05', IF(id % 5 = 0, NULL, date_add(DATE '2020-01-01', CAST(id % 90 AS INT)))) AS l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, rows in {
        "part": "SELECT id AS p_partkey, IF(id = 3, NULL, concat('t', id % 3)) AS p_type FROM range(6)",
        "orders": "SELECT id AS o_orderkey, id % 4 AS o_custkey FROM range(30)",
        "customer": "SELECT id AS c_custkey, id % 2 AS c_nationkey FROM range(4)",
        "nation": "SELECT id AS n_nationkey, id AS n_regionkey FROM range(2)",
        "region": "SELECT id AS r_regionkey, concat('r', id) AS r_name FROM range(2)",
    }.items():
        spark.sql(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    assert tables.tasks_for(t.lineitem) is None
    plain = roles.multicat(t).collect()
    monkeypatch.setattr(roles, "tasks_for", lambda scan: tables.tasks_for(scan, 500))
    dealt = roles.multicat(t).collect()
    assert sorted(map(str, dealt)) == sorted(map(str, plain)) and len(set(dealt)) == len(dealt) > 100


def test_few_rows_leave_the_number_of_tasks_to_the_session(spark, sf_dir):
    assert tables.tasks_for(Tables(spark, sf_dir).region) is None
    assert tables.tasks_for(spark.range(1000), 10) == 100


def test_many_partitions_of_the_session_do_not_make_larger_tasks(spark, sf_dir, monkeypatch):
    """A session of more partitions than the line items need leaves their number to AQE, which joins them."""
    monkeypatch.setattr(roles, "tasks_for", lambda scan: tables.tasks_for(scan, 500))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert tables.tasks_for(spark.range(1000), 20) == 50
        weights = trends.ad_weights(roles.multicat(Tables(spark, sf_dir)))
        rows = [r["count"] for r in weights.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(rows) > 5_000 and max(rows) < 2 * 500


@pytest.mark.parametrize("key", ["pivot_month_cat", "weighted_counts_whole", "weighted_counts"])
def test_trends_of_many_line_items_keep_their_tasks_up_to_the_window(spark, sf_dir, monkeypatch, key):
    """The whole query, in a session of more partitions than the line items need: AQE joins none of the tasks below the window."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        plain = sorted(map(str, catalog.QUERIES[key](spark, sf_dir).collect()))
        monkeypatch.setattr(roles, "tasks_for", lambda scan: tables.tasks_for(scan, 500))
        dealt = catalog.QUERIES[key](spark, sf_dir)
        assert sorted(map(str, dealt.collect())) == plain and plain
        query = dealt._jdf.queryExecution()
        query.toRdd().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tasks = -(-Tables(spark, sf_dir).lineitem.count() // 500)
    plan = query.executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    window = next(i for i, line in enumerate(plan) if "Window [" in line)
    below = [line for line in plan[window:] if "Exchange hashpartitioning(" in line or "AQEShuffleRead" in line]
    assert f", {tasks}), REPARTITION_BY_NUM" in below[0]


def test_tasks_of_a_shuffle_are_no_fewer_than_the_cores(spark):
    assert tables.tasks_for(spark.range(1000), 1000) is None
    assert tables.tasks_for(spark.range(1001), 1000) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("start", [False, True])
def test_phrases_that_can_fit_no_rule_are_left_out_before_the_join(spark, start):
    rows = [(1, "one two, three"), (2, " two three"), (3, None), (4, ""), (5, "three-two"), (6, "...")]
    texts = spark.createDataFrame(rows, "id int, text string")
    firsts = spark.range(1).select(rule_table._bucket(F.lit("two"))).first()[0]
    whole, cut = (texts.select("id", rule_table.text_phrases(F.col("text"), 2, start, known).alias("p")).collect()
                  for known in (None, [firsts]))
    for a, b in zip(whole, cut):
        assert [p for p in a.p or [] if p.startswith("two")] == (b.p or [])
    assert whole[0].p == (["one", "one two"] if start else ["one", "two", "three", "one two", "two, three"])
    rules = spark.createDataFrame([("two three", "x", 1), ("Two", "y", 2), ("", "z", 0)], rule_table.RULES)
    found = dict(map(tuple, rule_table.level_by_rules(texts, ["id"], "text", rules, at_start=start).collect()))
    assert found == {1: None if start else "y", 2: None if start else "x", 3: None, 4: None, 5: None if start else "y", 6: None}
    plan = rule_table._hits(texts, ["id"], "text", rules, start)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan.lower() and "getbit" in plan


def test_rules_of_none_find_nothing(spark):
    texts = spark.createDataFrame([(1, "one two")], "id int, text string")
    rules = spark.createDataFrame([], rule_table.RULES)
    assert rule_table.level_by_rules(texts, ["id"], "text", rules).collect() == [(1, None)]


def test_few_texts_are_unescaped_at_once(monkeypatch):
    """The batch goes by Arrow in steps; it is no series of as many Python texts."""
    most = []
    array = pa.array

    def counted(values, *rest):
        most.append(len(values))
        return array(values, *rest)

    texts = array([None, "", "a &amp; b &copy", "&#65;é&nbsp;"] * 75, pa.string())
    monkeypatch.setattr(text.pa, "array", counted)
    unescaped = text._unescape.func(texts)
    assert unescaped.to_pylist() == [None if x is None else html.unescape(x) for x in texts.to_pylist()]
    assert unescaped.type == pa.string() and max(most) <= 100 and len(text._unescape.func(texts[:0])) == 0


def test_unescaping_in_a_frame(spark):
    texts = spark.createDataFrame([(1, None), (2, "plain"), (3, "&lt;&eacute"), (4, "a & b")], "id int, t string")
    found = texts.select("id", text.html_unescape(F.col("t"))).collect()
    assert sorted(map(tuple, found)) == [(1, None), (2, "plain"), (3, "<é"), (4, "a & b")]

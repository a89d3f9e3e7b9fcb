"""What the plans must not, and must, hold."""

import pytest

from adlake.plans import catalog

READS_BACK = {"csv_roundtrip", "doc_scan", "raw_pages", "lookup_csv", "partition_overwrite", "month_flush", "first_wins",
              "stream_first_wins", "stream_first_wins_exact", "stream_upsert", "classified_run", "board_run",
              "stream_first_wins_state", "stream_upsert_buckets", "weighted_counts_loads", "archive_in_place",
              "load_counts", "load_summaries", "load_links", "load_resumes", "store_translations", "csv_good_rows",
              "open_documents", "preview_by_partition"}


def plan(spark, sf_dir, key):
    return catalog.QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [k for k in catalog.QUERIES if k not in READS_BACK])
def test_no_cross_join_and_no_row_python(spark, sf_dir, key):
    text = plan(spark, sf_dir, key)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroups"):
        assert bad not in text


@pytest.mark.parametrize("key, pushed", [
    ("weekly_rotation", "GreaterThanOrEqual(o_orderdate"), ("recent_days", "GreaterThanOrEqual(ts"),
    ("exclude_two", "IsNotNull(o_custkey)"), ("links_left_docs", "In(source"),
])
def test_filters_reach_the_scan(spark, sf_dir, key, pushed):
    assert pushed in plan(spark, sf_dir, key)


def test_only_needed_columns_are_read(spark, sf_dir):
    scans = [line for line in plan(spark, sf_dir, "top5_categories").splitlines() if "ReadSchema" in line]
    assert scans
    for line in scans:
        schema = line.split("ReadSchema: struct<")[1]
        assert "l_extendedprice" not in schema and "o_totalprice" not in schema and "c_name" not in schema


def test_terms_of_a_text_are_counted_without_a_shuffle(spark, sf_dir):
    # The one exchange that may be there spreads a table of few splits.
    text = plan(spark, sf_dir, "top_terms")
    assert text.count("Exchange") - text.count("REBALANCE_PARTITIONS_BY_NONE") <= 0 and "Aggregate" not in text


def test_small_pages_are_not_joined_with_their_text(spark, sf_dir):
    lines = plan(spark, sf_dir, "page_status").splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("html" in line and "Exchange" in line for line in lines[join:])


@pytest.mark.parametrize("key", ["map_or_keep", "since_mark"])
def test_small_side_is_broadcast_once_its_size_is_known(spark, sf_dir, key):
    query = catalog.QUERIES[key](spark, sf_dir)._jdf.queryExecution()
    query.toRdd().count()
    text = query.executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_trends_gather_no_country(spark, sf_dir):
    for key in ("category_change", "first_last_month", "top5_share"):
        text = plan(spark, sf_dir, key)
        assert "collect_list" not in text and "WindowGroupLimit" in text and "Partial" in text


def test_line_items_are_not_dealt_out_before_their_aggregate(spark, sf_dir):
    for key in ("cats_per_ad", "weighted_counts", "pivot_month_cat"):
        assert "REBALANCE" not in plan(spark, sf_dir, key)


def test_translation_reads_the_documents_once(spark, sf_dir):
    query = catalog.QUERIES["needs_translation"](spark, sf_dir)._jdf.queryExecution()
    assert query.executedPlan().toString().split("== Initial Plan ==")[0].count("documents.parquet") == 1

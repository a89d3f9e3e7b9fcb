from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from adlake import session
from adlake.operators import maintenance
from adlake.sources import schemas, tables

D = date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def new_rows(spark):
    return spark.createDataFrame(
        [(1, D(2020, 1, 1), "b", 2), (1, D(2020, 1, 1), "a", 1), (2, D(2020, 1, 1), "c", 3),
         (3, None, "d", 4), (3, None, "e", 5), (None, D(2020, 1, 1), "f", 6)],
        "uid int, postdate date, title string, arrival int")


def test_first_wins_keeps_null_keys_and_first_arrival(spark, new_rows):
    old = spark.createDataFrame([(2, D(2020, 1, 1), "stored", 0)], new_rows.schema)
    added = maintenance.first_wins(new_rows, ["uid", "postdate"], ["arrival"], old)
    assert [r[2] for r in rows(added, "arrival")] == ["a", "d", "e", "f"]


def test_first_wins_is_idempotent(new_rows):
    keys = ["uid", "postdate"]
    once = maintenance.first_wins(new_rows, keys, ["arrival"])
    again = maintenance.first_wins(new_rows, keys, ["arrival"], old=once)
    # Only rows whose key holds a null come in again, as nothing collides with them.
    assert {r[2] for r in rows(again, "arrival")} == {"d", "e", "f"}


def test_first_wins_of_keys_alone(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "uid int")
    assert [r.uid for r in maintenance.first_wins(df, ["uid"], ["uid"]).orderBy("uid").collect()] == [None, None, 1]


def test_first_wins_hot_key(spark):
    """A key that holds a third of all rows still gives its first row."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("uid"),
        (30000 - F.col("id")).alias("arrival"))
    first = maintenance.first_wins(df, ["uid"], ["arrival"]).filter("uid = 7").collect()
    assert [tuple(r) for r in first] == [(7, 3)]


def test_archive_parts_make_the_whole(spark):
    page = spark.createDataFrame(
        [(1, "OPEN", D(2020, 6, 1)), (1, "CLOSED", D(2020, 6, 2)), (2, "OPEN", D(2020, 1, 1)),
         (3, "OPEN", D(2020, 6, 1)), (4, "OPEN", None), (None, "OPEN", D(2020, 6, 1))],
        "uid int, stat string, postdate date")
    gone = maintenance.gone_ads(page, D(2020, 6, 30))
    moved, live = maintenance.archive_moved(page, gone), maintenance.archive_live(page, [gone])
    assert {r.uid for r in moved.collect()} == {1, 2}
    assert moved.count() == 3  # uid 1 goes whole
    assert sorted(map(str, moved.union(live).collect())) == sorted(map(str, page.collect()))
    earlier = spark.createDataFrame([(3,)], "uid int")
    assert {r.uid for r in maintenance.archive_live(page, [gone, earlier]).collect()} == {4, None}


def test_archive_age_limit(spark):
    page = spark.createDataFrame([(1, "OPEN", D(2020, 4, 1)), (2, "OPEN", D(2020, 3, 31))],
                                 "uid int, stat string, postdate date")
    gone = maintenance.gone_ads(page, D(2020, 6, 30))  # 90 days before is April 1
    assert [r.uid for r in gone.collect()] == [2]


UPSERT = "id int, loaded date, body string"


def test_stale_upsert(spark):
    old = spark.createDataFrame([(1, D(2020, 1, 1), "old"), (2, D(2020, 5, 31), "old"), (3, D(2020, 1, 1), "old")], UPSERT)
    new = spark.createDataFrame([(1, D(2020, 6, 30), "new"), (2, D(2020, 6, 30), "new"), (4, D(2020, 6, 29), "new"),
                                 (4, D(2020, 6, 30), "newer")], UPSERT)
    now = D(2020, 6, 30)  # documents loaded before May 31 are stale
    merged = maintenance.stale_upsert(old, new, "id", "loaded", now)
    assert [(r[0], r[2]) for r in rows(merged)] == [(1, "new"), (2, "old"), (3, "old"), (4, "newer")]
    changes = maintenance.upsert_changes(old, new, "id", "loaded", now)
    assert [(r[0], r[2]) for r in rows(changes)] == [(1, "new"), (4, "newer")]


@pytest.mark.parametrize("known", [[], [(0, "b"), (1, "z")]])
def test_status_names(spark, known):
    known_names = spark.createDataFrame(known, "id int, jobstat string")
    seen = spark.createDataFrame(
        [("c", D(2020, 1, 3), 1), ("a", D(2020, 1, 1), 2), ("b", D(2020, 1, 1), 1), ("a", D(2020, 1, 9), 0),
         ("d", D(2020, 1, 3), 0), (None, D(2020, 1, 1), 0)], "stat string, day date, n int")
    names = maintenance.extend_status_names(known_names, seen, "stat", ["day", "n"], F.col("day"))
    got = {r.jobstat: r.id for r in names.collect()}
    if known:
        assert got == {"b": 0, "z": 1, "a": 2, "d": 3, "c": 4}
    else:
        assert got == {"b": 0, "a": 1, "d": 2, "c": 3}


def test_number_in_order_is_dense(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("day"))
    numbered = maintenance.number_in_order(df, ["day", "id"], F.col("day"), "n").orderBy("day", "id").collect()
    assert [r.n for r in numbered] == list(range(1000))


def test_errors(spark):
    docs = spark.createDataFrame([(1, None), (2, "x")], "id int, error string")
    left = maintenance.drop_errors(docs)
    maintenance.assert_no_errors(left)
    assert left.count() == 1
    with pytest.raises(AssertionError):
        maintenance.assert_no_errors(docs)


def test_empty_tables_keep_the_schema(spark):
    for name, schema in schemas.SCHEMAS.items():
        empty = tables.create_empty(spark, schema)
        assert empty.count() == 0
        assert tables.empty_like(empty).schema == schema
        assert set(schemas.KEYS[name]) <= set(schema.fieldNames())


def test_schema_sizes():
    assert len(schemas.SCHEMAS["page"]) == 22
    assert len(schemas.SCHEMAS["job_page"]) == 28
    assert schemas.SCHEMAS["listing"].fieldNames()[-1] == "href"


def test_migrate_reorders_widens_and_adds(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    wide = tables.migrate(df, schemas.columns("c string, id bigint, extra date"), {"a": "id", "b": "c"})
    assert [tuple(r) for r in wide.collect()] == [("x", 1, None)]
    assert wide.schema["id"].dataType.simpleString() == "bigint"


def test_csv_roundtrip_with_quotes_and_newlines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nthen go', D(2020, 2, 29)), (2, None, None)],
                               "id int, body string, day date")
    tables.write_csv(df, f"{tmp_path}/t")
    assert rows(tables.scan_csv(spark, f"{tmp_path}/t", df.schema, multi_line=True)) == rows(df)


def test_lookup_last_line_wins(spark, tmp_path):
    (tmp_path / "map.csv").write_text("a,1\nb,2\na,3\n")
    lookup = tables.scan_lookup(spark, str(tmp_path / "map.csv"))
    assert rows(lookup) == [("a", "3"), ("b", "2")]


def test_documents_without_error(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id":1}\n{"id":2,"error":"x"}\n{"id":3,"skills":["a"]}\n')
    docs = tables.scan_documents(spark, str(tmp_path / "d.json"), schemas.SCHEMAS["resumes"])
    assert sorted(r.id for r in docs.collect()) == [1, 3]


def test_partition_refresh_leaves_others(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "eg"), (2, "jo"), (3, "eg")], "uid int, country string")
    tables.write_table(df, path, ["country"])
    tables.refresh_partitions(spark.createDataFrame([(9, "eg")], df.schema), path, ["country"])
    assert rows(spark.read.parquet(path)) == [(2, "jo"), (9, "eg")]
    old = spark.createDataFrame([(1, "eg"), (2, "jo"), (4, None)], df.schema)
    new = spark.createDataFrame([(5, "eg"), (6, "jo")], df.schema)
    kept = maintenance.refresh_partition(old, new, "country", ["eg"])
    assert {r.uid for r in kept.collect()} == {2, 4, 5}


def test_flush_only_on_the_first(spark, tmp_path):
    path = f"{tmp_path}/archive"
    staged = spark.createDataFrame([(1,), (2,)], "uid int")
    assert not tables.flush_archive(staged, path, D(2020, 6, 2))
    assert tables.flush_archive(staged, path, D(2020, 6, 1))
    assert tables.flush_archive(staged, path, D(2020, 6, 1))  # a retry changes nothing
    assert sorted(r.uid for r in spark.read.parquet(path).filter("month = 202006").collect()) == [1, 2]


def test_raw_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>")], "page_id int, url string, html string")
    for day in (D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 2)):  # the last day is run twice
        tables.save_raw_pages(pages, f"{tmp_path}/raw", day)
    assert rows(spark.read.parquet(f"{tmp_path}/raw").select("page_id", "html")) == [(1, "<p>"), (1, "<p>")]


def test_upsert_of_nested_documents(spark):
    from adlake.sources.schemas import SCHEMAS
    def doc(uid, when, skill, **more):
        return {"id": uid, "downloaddate": datetime(2020, *when), "skills": [skill], "personal": {"b": skill, "a": "1"}, **more}

    schema, now = SCHEMAS["resumes"], D(2020, 6, 1)
    old = spark.createDataFrame([doc(1, (5, 30), "fresh"), doc(2, (1, 1), "stale")], schema)
    new = spark.createDataFrame([doc(1, (6, 1), "x"), doc(2, (6, 1), "b"), doc(2, (6, 1), "a"), doc(3, (6, 1), "n")], schema)
    merged = {r.id: r.skills[0] for r in maintenance.stale_upsert(old, new, "id", "downloaddate", now).collect()}
    changes = {r.id: r.skills[0] for r in maintenance.upsert_changes(old, new, "id", "downloaddate", now).collect()}
    assert merged[1] == "fresh" and merged[3] == "n" and merged[2] in "ab" and set(merged) == {1, 2, 3}
    assert changes == {2: merged[2], 3: "n"}


def test_first_wins_with_a_map(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 2, map('a', 1)), (1, 1, map('b', 2)), (2, 5, map('c', 3)) AS t(k, o, m)")
    assert sorted((r.k, r.o, r.m) for r in maintenance.first_wins(df, ["k"], ["o"]).collect()) == [(1, 1, {"b": 2}), (2, 5, {"c": 3})]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    page = spark.range(1000).selectExpr("id % 200 AS uid", "IF(id % 7 = 0, 'CLOSED', 'OPEN') AS stat",
                                        "DATE '2020-06-01' AS postdate")
    tables.write_bucketed(page, "bucketed_page", ["uid"], 4, f"{tmp_path}/page")
    tables.write_bucketed(page.select("uid").distinct(), "bucketed_ads", ["uid"], 4, f"{tmp_path}/ads")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, ads = spark.table("bucketed_page"), spark.table("bucketed_ads")
        gone = maintenance.gone_ads(stored, D(2020, 6, 30))
        for frame in (maintenance.archive_moved(stored, gone), maintenance.archive_live(ads, [gone]),
                      maintenance.first_wins(stored, ["uid"], ["stat", "postdate"], old=ads)):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        assert maintenance.archive_moved(stored, gone).count() == maintenance.archive_moved(page, gone).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_page")
        spark.sql("DROP TABLE bucketed_ads")


def test_export_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    tables.export_csv({"one": df, "two": df}, str(tmp_path))
    assert rows(tables.scan_csv(spark, f"{tmp_path}/two", df.schema, multi_line=True)) == [(1, "a")]


class FakeSession:
    def __init__(self, master, folder):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder} if folder else {}, self
        self.master = master


def test_scratch_folder():
    assert session.scratch_path(FakeSession("yarn", "hdfs://n/shared/"), "x").startswith("hdfs://n/shared/adlake/x-")
    with pytest.raises(ValueError):
        session.scratch_path(FakeSession("yarn", None), "x")
    assert session.scratch_path(FakeSession("local[2]", None), "x") != session.scratch_path(FakeSession("local[2]", None), "x")

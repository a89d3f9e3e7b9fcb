from datetime import datetime, timedelta

from pyspark.sql import functions as F

from adlake.streaming import ingest

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, body string"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def arrivals(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ingest.read_files(spark, folder, schema, "*.parquet", files_per_batch=1)


def day(n):
    return START + timedelta(days=n)


def test_first_wins_over_runs(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run():
        ingest.first_wins_available(arrivals(spark, folder), out, state, ["id"], ["ts", "body"])

    write(spark, folder, [(1, day(0), "a"), (2, day(1), "a"), (1, day(0), "a")])
    run()
    write(spark, folder, [(1, day(5), "b"), (3, day(5), "b")])
    run()
    run()  # nothing new: nothing added
    assert sorted((r.id, r.body) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_exact_first_wins_has_no_bound(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run():
        ingest.first_wins_available(arrivals(spark, folder), out, state, ["id"], ["ts", "body"])

    write(spark, folder, [(1, day(400), "b"), (1, day(400), "a")])
    run()
    write(spark, folder, [(1, day(500), "c"), (2, day(0), "late"), (None, day(0), "n"), (None, day(0), "n")])
    run()
    got = sorted(str((r.id, r.body)) for r in spark.read.parquet(out).collect())
    assert got == ["(1, 'a')", "(2, 'late')", "(None, 'n')", "(None, 'n')"]


def test_upsert_over_batches(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run(now):
        ingest.upsert_available(arrivals(spark, folder), out, state, "id", "ts", now.date())
        return {r.id: r.body for r in ingest.read_documents(spark, out, "id").collect()}

    write(spark, folder, [(1, day(0), "one"), (2, day(20), "two")])
    assert run(day(20)) == {1: "one", 2: "two"}
    write(spark, folder, [(1, day(40), "one again"), (2, day(40), "two again"), (3, day(40), "three")])
    assert run(day(40)) == {1: "one again", 2: "two", 3: "three"}  # only document 1 was stale
    assert run(day(80)) == {1: "one again", 2: "two", 3: "three"}
    assert spark.read.parquet(out).filter(F.col("version") == 1).count() == 2  # changes only
    ingest.compact(spark, out, f"{tmp_path}/compact", "id")
    assert {r.id: r.body for r in ingest.read_documents(spark, f"{tmp_path}/compact", "id").collect()} == {
        1: "one again", 2: "two", 3: "three"}
    assert [r.version for r in spark.read.parquet(f"{tmp_path}/compact").select("version").distinct().collect()] == [1]

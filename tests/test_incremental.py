import random
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from adlake.streaming import incremental, ingest

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, part string, ts timestamp, body string"


def day(n):
    return START + timedelta(days=n)


def write(spark, folder, rows, files=1):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(folder)
    time.sleep(0.01)


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def load(spark, base, files=1000):
    incremental.first_wins_stateful(spark, f"{base}/in", schema(spark), "*.parquet", f"{base}/out", f"{base}/state",
                                    ["id", "part"], ["ts", "body"], files)


def stored(spark, path):
    return sorted(str((r.id, r.part, r.ts, r.body)) for r in spark.read.parquet(path).collect())


def batch_of(rng, n):
    """Late rows, ties by date, repeated rows, a hot key and nulls in the key."""
    return [(rng.choice([None, 1, *range(20 + n)]), rng.choice(["a", "a", None, "b"]), day(rng.randrange(60)),
             rng.choice(["x", "y", None])) for _ in range(60)] + [(1, "hot", day(n), f"b{i}") for i in range(30)]


def test_ten_batches_and_restarts_equal_the_table_check(spark, tmp_path):
    rng = random.Random(3)
    for n in range(10):
        write(spark, f"{tmp_path}/in", batch_of(rng, n), files=2)
        if n in (0, 1, 4, 9):   # restarts; several arrivals at once in between
            load(spark, tmp_path)
            arrivals = ingest.read_files(spark, f"{tmp_path}/in", schema(spark), "*.parquet")
            ingest.first_wins_available(arrivals, f"{tmp_path}/out2", f"{tmp_path}/state2", ["id", "part"], ["ts", "body"])
    load(spark, tmp_path)   # nothing new
    assert stored(spark, f"{tmp_path}/out") == stored(spark, f"{tmp_path}/out2")


def test_a_batch_does_not_scan_the_table(spark, tmp_path, monkeypatch):
    write(spark, f"{tmp_path}/in", [(1, "a", day(0), "x")])
    load(spark, tmp_path)
    for f in Path(f"{tmp_path}/out").rglob("*.parquet"):
        f.write_bytes(b"unreadable")   # a batch that read the table would fail
    write(spark, f"{tmp_path}/in", [(1, "a", day(0), "x"), (2, "a", day(1), "y")])
    load(spark, tmp_path)
    assert stored(spark, f"{tmp_path}/out/version=1") == [str((2, "a", day(1), "y"))]


def test_a_batch_that_failed_runs_again_alike(spark, tmp_path):
    rng = random.Random(4)
    write(spark, f"{tmp_path}/in", batch_of(rng, 0))
    load(spark, tmp_path)
    write(spark, f"{tmp_path}/in", batch_of(rng, 1))
    load(spark, tmp_path)
    want = stored(spark, f"{tmp_path}/out")
    commits = Path(f"{tmp_path}/state/commits")
    (commits / "1").unlink()          # as if the second batch had broken off before its end
    (commits / ".1.crc").unlink(missing_ok=True)
    load(spark, tmp_path)
    assert stored(spark, f"{tmp_path}/out") == want


def upsert(spark, base, now):
    arrivals = ingest.read_files(spark, f"{base}/in", schema(spark), "*.parquet", files_per_batch=1)
    incremental.upsert_by_bucket(arrivals, f"{base}/docs", f"{base}/state", "id", "ts", now.date(), buckets=16)
    return {r.id: r.body for r in incremental.present_documents(spark, f"{base}/docs", "id").collect()}


@pytest.mark.parametrize("compacted", [False, True])
def test_upsert_by_bucket_equals_upsert(spark, tmp_path, compacted):
    rng = random.Random(8)
    for n in range(6):
        write(spark, f"{tmp_path}/in", [(rng.randrange(30), None, day(20 * n + rng.randrange(5)), f"{n}-{i}") for i in range(12)])
        got = upsert(spark, tmp_path, day(20 * n))
        arrivals = ingest.read_files(spark, f"{tmp_path}/in", schema(spark), "*.parquet", files_per_batch=1)
        ingest.upsert_available(arrivals, f"{tmp_path}/docs2", f"{tmp_path}/state2", "id", "ts", day(20 * n).date())
        assert got == {r.id: r.body for r in ingest.read_documents(spark, f"{tmp_path}/docs2", "id").collect()}
        if compacted:
            done = incremental.compact_buckets(spark, f"{tmp_path}/docs", "id", most_versions=1)
            assert got == {r.id: r.body for r in incremental.present_documents(spark, f"{tmp_path}/docs", "id").collect()}
            folders = [p.parent.name for p in Path(f"{tmp_path}/docs").glob("bucket=*/version=*")]
            assert len(folders) == len(set(folders)) and (n == 0 or done)


def test_a_batch_reads_the_buckets_that_arrived(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [(i, None, day(0), "x") for i in range(200)])
    upsert(spark, tmp_path, day(0))
    bucket = spark.range(5, 6).select(F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).first()[0]
    rows = incremental.stored_documents(spark, f"{tmp_path}/docs", schema(spark), [bucket], 1)
    assert rows.inputFiles() and all(f"bucket={bucket}/" in f for f in rows.inputFiles())
    scan = rows.select("id", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "version" in scan.split("PartitionFilters: [")[1].split("]")[0] and "body" not in scan.split("ReadSchema")[1]
    for f in Path(f"{tmp_path}/docs").rglob("*.parquet"):
        if f"bucket={bucket}/" not in str(f):
            f.write_bytes(b"unreadable")
    write(spark, f"{tmp_path}/in", [(5, None, day(40), "y")])
    arrivals = ingest.read_files(spark, f"{tmp_path}/in", schema(spark), "*.parquet", files_per_batch=1)
    incremental.upsert_by_bucket(arrivals, f"{tmp_path}/docs", f"{tmp_path}/state", "id", "ts", day(40).date(), buckets=16)
    got = incremental.stored_documents(spark, f"{tmp_path}/docs", schema(spark), [bucket], 9).filter("id = 5").collect()
    assert sorted(r.body for r in got) == ["x", "y"]

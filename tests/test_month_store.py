import random
from datetime import date
from pathlib import Path

import pytest
from test_trends import SCHEMA, brute_months, random_ads

from adlake.operators import month_store


def totals(spark, store, whole=False):
    return {(r.country, r.month, r.cat): r.total for r in month_store.category_months(spark, store, whole).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def frame(spark, ads):
    return spark.createDataFrame(ads, SCHEMA)


@pytest.mark.parametrize("seed", range(2))
def test_five_loads_equal_one_run(spark, tmp_path, seed):
    ads = random_ads(seed)
    random.Random(seed).shuffle(ads)
    ads.append(("eg", 3, "late", date(2021, 1, 1)))   # an ad that gains a category in the last load
    store = str(tmp_path)
    for n in range(5):
        month_store.load(frame(spark, ads[n * 120:n * 120 + 120 if n < 4 else None]), store, n, buckets=8)
        if n in (1, 4):
            month_store.load(frame(spark, ads[n * 120:n * 120 + 120 if n < 4 else None]), store, n, buckets=8)   # run again
        same(totals(spark, store), brute_months(ads[:n * 120 + 120] if n < 4 else ads))
    same(totals(spark, store, whole=True), brute_months(ads, whole=True))
    month_store.merge_moves(spark, store, f"{store}/one/moves")
    same(totals(spark, f"{store}/one"), brute_months(ads))


def test_a_load_reads_the_buckets_of_its_ads_and_writes_their_moves(spark, tmp_path):
    store = str(tmp_path)
    month_store.load(frame(spark, [("eg", i, "a", date(2020, 1, 1)) for i in range(100)]), store, 0, buckets=8)
    month_store.load(frame(spark, [("eg", 7, "b", date(2020, 3, 1))]), store, 1, buckets=8)
    moved = spark.read.parquet(f"{store}/moves").filter("version = 1").collect()
    assert {(r.month, r.cat, r.cats, r.n) for r in moved} == {
        (date(2020, 1, 1), "a", 1, -1), (date(2020, 1, 1), "a", 2, 1), (date(2020, 3, 1), "b", 2, 1)}
    mine = next(p.parent.parent for p in Path(store, "facts").glob("bucket=*/version=1/*.parquet"))
    for f in Path(store, "facts").rglob("*.parquet"):
        if mine not in f.parents:
            f.write_bytes(b"unreadable")
    month_store.load(frame(spark, [("eg", 7, "c", date(2020, 1, 1)), ("eg", 7, "b", date(2020, 3, 9))]), store, 2, buckets=8)
    got = totals(spark, store)
    assert got["eg", date(2020, 1, 1), "a"] == pytest.approx(99 + 1 / 3) and got["eg", date(2020, 3, 1), "b"] == pytest.approx(1 / 3)


def test_empty_load(spark, tmp_path):
    month_store.load(frame(spark, [("eg", 1, "a", None)]), str(tmp_path), 0)
    month_store.load(frame(spark, []), str(tmp_path), 1)
    assert totals(spark, str(tmp_path)) == {("eg", None, "a"): 1.0}

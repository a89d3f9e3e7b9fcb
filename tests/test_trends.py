import random
from collections import defaultdict
from datetime import date
from math import floor

import pytest

from adlake.operators import combine, stats, trends

SCHEMA = "country string, uid int, cat string, postdate date"


def random_ads(seed, n=400):
    rng = random.Random(seed)
    ads = [(rng.choice(["eg", "jo", None]), rng.choice([None, *range(40)]), rng.choice(["a", "b", "c", "d", None]),
            rng.choice([None, date(2020, rng.randint(1, 6), rng.randint(1, 28))])) for _ in range(n)]
    return ads + [("eg", 7, rng.choice("ab"), date(2020, 1, 1)) for _ in range(n // 2)]  # a hot ad


def brute_months(ads, whole=False):
    cats = defaultdict(set)
    for country, uid, cat, _ in ads:
        cats[country, uid].add(cat)
    totals = defaultdict(lambda: None)
    for country, month, uid, cat in {(c, d.replace(day=1) if d else None, u, k) for c, u, k, d in ads}:
        key = (country, month, cat)
        totals[key] = totals[key]  # a group exists even if all its weights are null
        if country is not None and uid is not None:
            weight = 1 / len(cats[country, uid])
            totals[key] = (totals[key] or 0) + (floor(weight) if whole else weight)
    return totals


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("whole", [False, True])
def test_months_equal_brute_force(spark, seed, whole):
    ads = random_ads(seed)
    months = trends.category_months(spark.createDataFrame(ads, SCHEMA), whole)
    got = {(r.country, r.month, r.cat): r.total for r in months.collect()}
    want = brute_months(ads, whole)
    assert got.keys() == want.keys()
    for key, total in want.items():
        assert got[key] == (None if total is None else pytest.approx(total))


def test_weights_of_one_ad_in_one_month_sum_to_one(spark):
    ads = [r for r in random_ads(5) if r[0] and r[1] is not None]
    once = [(c, u, k, date(2020, 1, 1)) for c, u, k, _ in ads]
    weights = trends.ad_weights(spark.createDataFrame(once, SCHEMA))
    sums = weights.groupBy("country", "uid").sum("weight").collect()
    assert all(r[2] == pytest.approx(1) for r in sums)


def test_an_ad_counts_again_each_month(spark):
    ads = spark.createDataFrame([("eg", 1, "a", date(2020, 1, 1)), ("eg", 1, "a", date(2020, 2, 1)),
                                 ("eg", 1, "b", date(2020, 2, 5))], SCHEMA)
    totals = trends.category_totals(trends.category_months(ads))
    assert {r.cat: r.total for r in totals.collect()} == {"a": 1.0, "b": 0.5}


def test_null_category_counts_as_one(spark):
    ads = spark.createDataFrame([("eg", 1, "a", None), ("eg", 1, None, None), ("eg", 1, "a", None)], SCHEMA)
    assert trends.cats_per_ad(ads).collect()[0].cats == 2


def test_share_and_span_and_change(spark):
    months = spark.createDataFrame([
        ("eg", date(2020, 1, 1), "a", 6.0), ("eg", date(2020, 3, 1), "a", 2.0), ("eg", None, "a", 1.0),
        ("eg", date(2020, 2, 1), "b", 1.0), ("eg", date(2019, 1, 1), "c", 0.5), ("eg", date(2020, 3, 1), "d", 0.25),
        ("eg", date(2020, 1, 1), "d", 0.5), ("jo", date(2020, 5, 1), "a", 1.0),
    ], "country string, month date, cat string, total double")
    # 9 of 11.25 ads hold place 1 to 1, of which 8 are dated.
    assert {r.country: r.top_pct for r in trends.top_share(months, 1).collect()} == {"eg": 71, "jo": 100}
    span = {r.country: (r.first_month, r.last_month) for r in trends.month_span(months, 2).collect()}
    assert span["eg"] == (date(2020, 1, 1), date(2020, 3, 1))  # c is not among the top two
    change = trends.category_change(months, n=1, top=2).filter("country = 'eg'").collect()
    assert {(r.cat, r.change, r.lowest, r.highest) for r in change} == {("a", -4.0, 1, 2), ("d", -0.25, 2, 1)}


def brute_change(months, n, top):
    """Places of all changes of each country, by sorting them all."""
    out = set()
    for country in {r[0] for r in months}:
        rows = [r for r in months if r[0] == country]
        name = lambda c: (c is not None, c or "")
        totals = {c: sum(r[3] for r in rows if r[2] == c) for c in {r[2] for r in rows}}
        largest = sorted(totals, key=lambda c: (-round(totals[c], 9), name(c)))[:top]
        seen = [r[1] for r in rows if r[2] in largest and r[1]]
        if not seen:
            continue
        at = {(r[2], r[1]): r[3] for r in rows}
        change = {c: at[c, max(seen)] - at[c, min(seen)] for c in totals if (c, max(seen)) in at and (c, min(seen)) in at}
        up = sorted(change, key=lambda c: (round(change[c], 9), name(c)))
        down = sorted(change, key=lambda c: (-round(change[c], 9), name(c)))
        out |= {(country, c, change[c], up.index(c) + 1, down.index(c) + 1) for c in up[:n] + down[:n]}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_changes_with_many_ties_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = {(rng.choice(["eg", "jo", None]), rng.choice([None, *(date(2020, m, 1) for m in range(1, 4))]),
             rng.choice([None, *(f"c{i}" for i in range(25))])) for _ in range(400)}
    months = [(*k, float(rng.randint(0, 3))) for k in keys]
    df = spark.createDataFrame(months, "country string, month date, cat string, total double")
    got = trends.category_change(df, n=4, top=3).collect()
    assert {tuple(r) for r in got} == brute_change(months, 4, 3) and len(got) == len(set(got))


def test_a_country_of_many_categories(spark):
    months = spark.range(300_000).selectExpr(
        "'eg' AS country", "IF(id % 2 = 0, DATE '2020-01-01', DATE '2020-05-01') AS month",
        "concat('c', lpad(id div 2, 6, '0')) AS cat", "CAST(IF(id < 4, 1000, id * 7919 % 1009) AS DOUBLE) AS total")
    months = months.unionByName(months.selectExpr("IF(cat < 'c000003', 'jo', NULL) AS country", "month", "cat", "total")
                                .filter("cat < 'c000006'"))
    got = trends.category_change(months, n=20).filter("country = 'eg'").collect()
    total = [1000 if i < 4 else i * 7919 % 1009 for i in range(300_000)]
    change = {f"c{i:06}": total[2 * i + 1] - total[2 * i] for i in range(150_000)}
    up = {c: k for k, c in enumerate(sorted(change, key=lambda c: (change[c], c)), 1)}
    down = {c: k for k, c in enumerate(sorted(change, key=lambda c: (-change[c], c)), 1)}
    assert {(r.cat, r.change, r.lowest, r.highest) for r in got} == {
        (c, change[c], up[c], down[c]) for c in change if up[c] <= 20 or down[c] <= 20}


def test_availability_and_shares(spark):
    df = spark.createDataFrame([("eg", "f", 1), ("eg", None, None), ("jo", "m", None), (None, "f", 2)],
                               "country string, gender string, age int")
    missing = {r.variable: r.pct for r in stats.missing_pct(df, ["gender", "age"]).collect()}
    assert missing == {"gender": 25.0, "age": 50.0}
    groups = stats.available_by_group(df, "country", ["gender"], more_than=1).collect()
    assert [(r.country, r.pct) for r in groups] == [("eg", 50.0)]
    share = {(r.country, r.gender): r.share for r in stats.value_share(df, "country", "gender").collect()}
    assert share["eg", "f"] == 0.25
    share = stats.value_share(df, "country", "gender", denominator="group").filter("country = 'eg'").collect()
    assert share[0].share == 0.5


def test_summary_drops_null_groups_and_skips_null_values(spark):
    df = spark.createDataFrame([("eg", "a", 1, 2.0), ("eg", "a", None, None), ("eg", None, 3, 4.0)],
                               "country string, cat string, uid int, pay double")
    assert [tuple(r) for r in stats.summary_stats(df, ["country", "cat"], "uid", ["pay"]).collect()] == [
        ("eg", "a", 1, 2.0)]


def test_active_within(spark):
    df = spark.createDataFrame([(date(2020, 6, 1),), (date(2020, 3, 31),), (date(2019, 6, 1),), (None,)], "d date")
    shares = {r.months: r.share for r in stats.active_within(df, "d", date(2020, 6, 15)).collect()}
    assert shares == {1: 0.25, 3: 0.5, 6: 0.5, 12: 0.75}


def test_latest_snapshot_keeps_ties(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 2), "a"), (1, date(2020, 1, 2), "b"), (1, date(2020, 1, 1), "c"),
                                (2, date(2020, 1, 1), "d")], "uid int, day date, x string")
    assert {r.x for r in combine.latest_snapshot(df, ["uid"], "day").collect()} == {"a", "b", "d"}


def test_left_with_many_equals_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (None, 13)], "k int, y int")
    want = left.join(right, "k", "left").collect()
    assert sorted(map(str, combine.left_with_many(left, right, ["k"]).collect())) == sorted(map(str, want))

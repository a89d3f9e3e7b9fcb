import random

import numpy as np
import pytest
from helpers import rows

from adlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, n string, copies string"


def water_level(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by source, capped one round at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        over = {s for s in names if target[s] > cap * sizes[s]} - full
        if not over:
            return target
        full |= over


def corpus(n=400):
    rng = random.Random(5)
    data = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "b", "é", "z", "Z", None, "a" if i % 3 else "b"]), "x", "y", "z") for i in range(n)]
    return data + [(9000, None, "a", "x", "y", "z"), (None, "one two", "b", "x", "y", "z")] + [(7, "hot row again", "z", "x", "y", "z")] * 200


def test_targets_and_sums(spark):
    data = corpus()
    docs = spark.createDataFrame(data, SCHEMA)
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"))
    got = rows(mixing.per_row(mixing.copies(sized, ["doc_id"])))
    sizes, largest = {}, {}
    for _, t, s, *_ in data:
        n = len((t or "").split())
        sizes[s], largest[s] = sizes.get(s, 0) + n, max(largest.get(s, 0), n)
    want = water_level(sizes)
    assert len(got) == len(data)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(r["target"] == pytest.approx(target) for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target) <= largest[s]
    assert all(0 <= r["copies"] <= 2 for r in got)


def test_reruns_and_other_partitions_agree(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    one = sorted(map(str, rows(mixing.mixed(docs.repartition(7)))))
    two = sorted(map(str, rows(mixing.mixed(docs.orderBy("text").coalesce(1)))))
    assert one == two and mixing.mixed(docs).columns == docs.columns


def test_tree_of_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    data = [(i, "a b c d", f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"))
    for r in rows(mixing.summary(mixing.copies(sized, ["doc_id"], bucket_rows=5))):
        assert abs(r["taken"] - r["target"]) <= 4


def test_settle_keeps_the_sum_and_is_fair():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 41).astype(float)
    chance = rng.random(41)
    hits = np.zeros(41)
    for i in range(4000):
        mass = mixing.settle(chance * size, size, np.random.default_rng(i))
        assert mass.sum() == pytest.approx((chance * size).sum())
        assert ((mass > 1e-9) & (mass < size - 1e-9)).sum() <= 1
        hits += mass / size
    assert np.abs(hits / 4000 - chance).max() < 0.05


def test_empty_and_wordless(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, "", "a", "", "", ""), (2, None, None, "", "", "")], SCHEMA)
    assert mixing.mixed(blank).count() == 2

import collections
import random

import numpy as np
import pytest
from helpers import rows

from adlake.llm import sharding


@pytest.mark.parametrize(("n", "parts", "cell"), [(1000, 7, 100_000), (1000, 3, 10), (5, 3, 2), (0, 1, 5)])
def test_exact_sizes_and_gapless_slots(spark, n, parts, cell):
    schema = "id long, text string, shard string, slot string, __part int"
    docs = spark.createDataFrame([(i if i % 3 else 1, None if i % 5 == 0 else "t", "a", "b", 1) for i in range(n)], schema)
    out = sharding.sharded(docs.repartition(parts), shards=24, cell_rows=cell)
    got = rows(out)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == n and out.columns == ["id", "text", "__part", "shard", "slot"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, ())) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert collections.Counter(r["id"] for r in got) == collections.Counter(i if i % 3 else 1 for i in range(n))


def test_matrix_sums_and_law():
    parts, shards = [50, 0, 30, 20], [40, 35, 25]
    total = np.zeros((4, 3))
    for seed in range(3000):
        m = sharding.matrix(parts, shards, seed)
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == shards
        total += m
    assert np.abs(total / 3000 - np.outer(parts, shards) / 100).max() < 0.3


def test_draws_of_large_populations():
    rng = np.random.default_rng(1)
    got = np.array([sharding.draw(rng, 3 * 10**9, 10**9, 1000) for _ in range(3000)])
    assert abs(got.mean() - 750) < 1 and abs(got.var() - 187.5) < 20
    small = np.random.default_rng(1).hypergeometric(3 * 10**6, 10**6, 1000, 3000)
    assert abs(small.var() - got.var()) < 30
    assert sharding.draw(rng, 10**10, 0, 500) == 500 and sharding.draw(rng, 0, 10**10, 500) == 0


def test_pairs_of_rows_meet_about_as_often_as_chance(spark):
    docs = spark.createDataFrame([(i,) for i in range(2400)], "id long").repartition(4)
    got = rows(sharding.sharded(docs, 24))
    same = sum(1 for r in got if r["shard"] == random.Random(r["id"]).randrange(24))
    assert 50 <= same <= 160


def test_reruns_agree(spark, tmp_path):
    spark.range(500).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(str, rows(sharding.sharded(docs)))) == sorted(map(str, rows(sharding.sharded(docs))))

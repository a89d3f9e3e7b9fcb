import math
import random

import pytest
from helpers import rows

from adlake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, id string"


def brute(data, asked, k):
    def ready(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    out = []
    for q, vector in {(i, tuple(v)) for i, v in asked if i is not None and ready(v) is not None}:
        scored = sorted((-sum(a * b for a, b in zip(ready(vector), ready(v))), i) for i, v in data
                        if i is not None and i != q and ready(v) is not None and len(v) == len(vector))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 800])
def test_equals_brute_force(spark, block_bytes):
    rng = random.Random(4)
    grid = [-1.0, -0.5, 0.0, 0.25, 1.0, 0.0039]                       # many ties
    data = [(i, [rng.choice(grid) for _ in range(4)]) for i in range(300)]
    data += [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(100)]     # a hot vector
    data += [(5, [1.0] * 4), (2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (None, [1.0] * 4),
             (2003, [float("inf"), 0.0, 0.0, 0.0]), (2050, [1.0, 2.0]), (2051, [3.0, 1.0]), (2100, []), (2150, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in data], SCHEMA).repartition(5)
    asked = [(i, v) for i, v in data if i is not None and i % 50 == 0]
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, block_bytes=block_bytes)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(got)) == brute(data, asked, 5)


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (1, [2.0], "", "")], SCHEMA)
    assert [(r["vec_id"], r["score"]) for r in rows(topk.top_k(df, df.filter("vec_id = 0")))] == [(1, 256 * 512)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [float(2**20), 1.0]), (1, [float(2**20), 1.0]), (2, [float(2**20), 3.0])],
                               "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["score"] for r in rows(topk.top_k(df, df.filter("vec_id = 0")))}
    assert got == {1: 2**56 + 65536, 2: 2**56 + 3 * 65536}

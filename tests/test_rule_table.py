import random

import pytest
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions import features
from adlake.operators import rule_table


def texts(seed, n=300):
    rng = random.Random(seed)
    parts = [p for ps in rules.EDUCATION_TERMS.values() for x in ps for p in rule_table.phrases(x)]
    glue = [" ", ", ", ".", "/", "-", "x", "", "\n", "é", " of "]
    rows = ["".join(x for _ in range(rng.randrange(7)) for x in (rng.choice([*parts, "plain", "word", "BSc"]), rng.choice(glue)))
            for _ in range(n)]
    return [(i, t) for i, t in enumerate([*rows, None, "", " ", "...", "Ph.D."])]


@pytest.mark.parametrize("seed", range(2))
def test_default_ladder_as_a_table_equals_the_chain(spark, seed):
    df = spark.createDataFrame(texts(seed), "id long, text string").repartition(4)
    table = rule_table.rules_of(spark, rules.EDUCATION_TERMS)
    got = {r.id: r.value for r in rule_table.level_by_rules(df, ["id"], "text", table).collect()}
    want = {r.id: r.v for r in df.select("id", features.first_level(F.lower("text"), rules.EDUCATION_TERMS).alias("v")).collect()}
    assert got == want and len(set(got.values())) > 5
    last = {r.id: r.value for r in rule_table.level_by_rules(df, ["id"], "text", table, last=True, at_start=True).collect()}
    want = {r.id: r.v for r in df.select("id", features.last_level(F.lower("text"), rules.EDUCATION_TERMS).alias("v")).collect()}
    assert last == want


def test_ten_thousand_rules_in_one_pass(spark):
    table = spark.range(10_000).selectExpr("concat('term ', id, ' x') AS phrase", "concat('v', id % 50) AS value", "CAST(id AS INT) AS rank")
    df = spark.createDataFrame([(1, "a Term 77 x, term 9999 x"), (2, "term 10 xy"), (3, "term 5  x term 6 x!")], "id long, text string")
    found = rule_table.level_by_rules(df, ["id"], "text", table)
    assert {r.id: r.value for r in found.collect()} == {1: "v27", 2: None, 3: "v6"}
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Generate explode") == 1
    counts = {r.value: r.n for r in rule_table.texts_by_rule(df, ["id"], "text", table).collect()}
    assert counts == {"v27": 1, "v49": 1, "v6": 1}


def test_phrases_of_patterns():
    assert rule_table.phrases(r"b(\.){0,1}[as](\.){0,1}") == ["b.a", "b.a.", "b.s", "b.s.", "ba", "ba.", "bs", "bs."]
    assert rule_table.phrases("university (graduates|degree)") == ["university degree", "university graduates"]
    assert rule_table.phrases("plain") == ["plain"]

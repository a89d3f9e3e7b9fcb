from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions import features, text
from adlake.operators import encode, stats, terms


def apply(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    column = build(F.col("c"))
    columns = column if isinstance(column, tuple) else (column,)
    got = df.select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1:] if isinstance(column, tuple) else r[1] for r in got]


CASES = {
    "slug": (text.slug, ["Kafr Al Sheikh", "St. John's (East) + West", "A--b"],
             ["kafr-al-sheikh", "st-john-s-east-west", "a-b"]),
    "count_label": (text.count_label, ["Cairo (1,234)", "Giza(7)", "Alone"], [("Cairo", 1234), ("Giza", 7), ("Alone", None)]),
    "clean_description": (text.clean_description, ["  a \n\t--\r b<!-- x -->c d\n", "...", None], ["a\nbc\nd", "", None]),
    "clean_description_arabic": (text.clean_description, ["سلام\n!!"], ["سلام"]),
    "flatten": (text.flatten_lines, ["a\r\nb\nc"], ["a >b>c"]),
    "strip_punct": (text.strip_punct, ["..Good; cook..", "A.B"], ["good cook", "a.b"]),
    "money": (text.money_digits, ["1,000 - 2,000", "EGP 3,500.", "none", None], [1000, 3500, None, None]),
    "money_all": (lambda c: text.money_digits(c, all_digits=True), ["1,000 - 2,000"], [10002000]),
    "salary": (text.salary_text, ["1,000", "Negotiable, 5"], ["1000", "Negotiable, 5"]),
    "arabic": (text.starts_arabic, ["اbc", "aا", "ي", "ً", ""], [True, False, True, False, False]),
    "location": (text.location_split, ["Egypt - Cairo", "Jordan"], [("Egypt", "Cairo"), ("Jordan", None)]),
    "unescape": (text.html_unescape, ["a &amp; b &lt;&eacute;&#39;", "plain", None], ["a & b <é'", "plain", None]),
    "capture": (lambda c: text.capture(c, r"(?:jobs/p/|internship/)(\d+)-"),
                ["/jobs/p/12-cook", "/internship/3-x", "/jobs/x12-"], ["12", "3", None]),
    "label": (lambda c: text.label_class(c, "Portal"),
              ["Acme Website Jobs", "Nurse Jobs", "Jobs in Cairo", "Portal picks", "Other"],
              [("publisher", "Acme"), ("occupation", "Nurse"), ("location", "Cairo"), ("publisher", "Portal picks"),
               (None, "Other")]),
    "alnum": (text.keep_alnum, ["Bachelor's Degree", "PhD"], ["BachelorsDegree", "PhD"]),
    "title": (text.title_label, ["saudi arabia"], ["Saudi Arabia"]),
    "experience": (features.experience_range,
                   ["2 to 4 years", "10 to 12 years", "More than 5 years", "Less than 1 years", "3 years", "any", None],
                   [(2, 4), (10, 12), (5, 30), (0, 1), (3, 3), (None, None), (None, None)]),
    "vacancies": (features.vacancies, ["5 open positions", "1 open position", "many", None], [5, 1, 1, 1]),
    "province": (lambda c: features.province(c), ["Nasr City, Cairo, Egypt", "Giza", "Rome"], ["Cairo", "Giza", "Other"]),
    "address": (features.full_address, ["Cairo", "Cairo, Egypt"], ["Cairo, Egypt", "Cairo, Egypt"]),
    "flag": (lambda c: features.equals_flag(c, "Female"), [" Female\n", "Male", None], [1, 0, 0]),
    "member": (lambda c: features.member_flag(c, ["a", "b"]), ["a", "c", None], [1, 0, 0]),
    "education": (lambda c: features.education_level(F.lit(None).cast("string"), c),
                  ["High school diploma or B.Sc", "University degree, MBA a plus", "Ph.D", "J.D. or law degree",
                   "registered nurse", "seeks a baker", None],
                  ["diploma", "bachelors", "doctorate", "jd", "rn", None, None]),
}


@pytest.mark.parametrize("name", CASES)
def test_column(spark, name):
    build, values, want = CASES[name]
    assert apply(spark, values, build) == want


def test_requirements_use_whole_words(spark):
    got = apply(spark, ["3 Good leaders >ms office (2), teams", "bs/ba or masters"],
                lambda c: text.normalise_requirements(F.lower(c)))
    assert got == [" good leadership microsoft office , teams", "bachelor or bachelor"]


def test_requirements_drop_traces_of_bytes(spark):
    assert apply(spark, ["b'caf\\\\xc3\\\\xa9 staff'>tidy\\\\"], text.normalise_requirements) == ["caf staff tidy"]


def test_last_level_wins_and_is_anchored(spark):
    ladder = {"one": ["small"], "two": ["small", "big"]}
    assert apply(spark, ["small job", "a small job", "smaller"], lambda c: features.last_level(c, ladder)) == [
        "two", None, None]


def test_coded_level_comes_first_then_further_patterns(spark):
    df = spark.createDataFrame([("masters", "diploma"), ("x", "diploma"), (None, "ليسانس"), (None, "x")], "c string, d string")
    level = features.education_level(F.col("c"), F.col("d"), further={"bachelors": ["ليسانس", "بكالوريوس"]})
    assert [r[0] for r in df.select(level).collect()] == ["masters", "diploma", "bachelors", None]


def test_compensation(spark):
    columns = features.compensation(F.col("c"))
    df = spark.createDataFrame([("1,500",), ("99",), ("",), ("ask",), (None,)], "c string").select(
        *[c.alias(n) for n, c in columns.items()])
    assert [tuple(r) for r in df.collect()] == [(1, 1, 1500.0), (1, 0, None), (0, 0, None), (0, 0, None), (0, 0, None)]


def test_clean_tokens_keep_repeats(spark):
    assert apply(spark, ["team work with great team experience and go"], text.clean_tokens) == [["team", "great", "team"]]


WORDS = st.lists(st.sampled_from(["aa", "b", "cé", "d", "ee"]), max_size=40)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lists=st.lists(WORDS, min_size=1, max_size=5))
def test_term_counts_equal_counter(spark, lists):
    df = spark.createDataFrame([(i, ws) for i, ws in enumerate(lists)], "i int, t array<string>")
    got = {r.i: r for r in df.select(
        "i", text.term_counts(F.col("t")).alias("n"), text.most_common(F.col("t"), 3).alias("top"),
        text.bigrams(F.col("t")).alias("pairs")).collect()}
    for i, ws in enumerate(lists):
        counts = Counter(ws)
        assert {x.term: x.n for x in got[i].n} == counts
        ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:3]
        assert [(x.term, x.n) for x in got[i].top] == ranked
        assert got[i].pairs == [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def test_bigrams_with_a_noun(spark):
    df = spark.createDataFrame([(1, ["time", "time", "plan", "quick", "slow"])], "i int, t array<string>")
    got = terms.top_bigrams(df, "i", F.col("t"), nouns=["time", "plan"])
    assert {r.term for r in got.collect()} == {"time plan", "plan quick"}


def test_keyword_totals_count_equal_texts_once(spark):
    df = spark.createDataFrame([(1, "Excel, excel!"), (1, "Excel, excel!"), (2, "Excel, excel!"), (2, "excels")], "id int, d string")
    got = terms.keyword_totals(df, ["id"], "d", ["excel"])
    assert [tuple(r) for r in got.collect()] == [("excel", 4)]


def test_skill_tags(spark):
    df = spark.createDataFrame([(1, ["excel", "problem", "solving", "team", "team"]), (2, [])], "i int, t array<string>")
    got = encode.skill_tags(df, "t").orderBy("i").collect()
    assert [(r.hard_skills, r.soft_skills) for r in got] == [(1, 2), (0, 0)]


def test_collapse_rare(spark):
    values = ["a"] * 60 + ["b"] * 5 + ["c"] * 4 + [None] * 31
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert Counter(r.x for r in encode.collapse_rare(df, ["x"]).collect()) == {"a": 60, "b": 5, "other": 4, None: 31}


def test_one_hot_names_and_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    hot, names = encode.one_hot(df, {"x": encode.indicator_values(df, "x")})
    assert names == ["x_a"] and [r.x_a for r in hot.collect()] == [1, 0]


def test_values_that_are_not_listed_show_in_the_rest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "x string")
    values = encode.indicator_values(df, "x", most=2)
    assert values == ["a", "b"]
    hot, names = encode.one_hot(df, {"x": values}, rest="rest")
    assert names == ["x_a", "x_b", "x_rest"] and sorted(r.x_rest for r in hot.collect()) == [0, 0, 0, 0, 1]
    many = encode.multi_hot(df.withColumn("y", F.lit("z")), ["x", "y"], ["a", "z"], "m", rest="rest")
    assert sorted((r.x or "", r.m_rest) for r in many.collect()) == [("", 0), ("a", 0), ("a", 0), ("b", 1), ("c", 1)]


def test_collapse_rare_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1)] * 9 + [("b", 2)], "x string, y int").withColumn("z", F.col("x"))
    got = Counter(tuple(r) for r in encode.collapse_rare(df, ["x", "z"], 0.2).collect())
    assert got == {("a", 1, "a"): 9, ("other", 2, "other"): 1}
    assert encode.collapse_rare(df.limit(0), ["x"]).count() == 0


def frequent(df, columns, share):
    return {(r.variable, r.value, r.n) for r in stats.frequent_values(df, columns, share).collect()}


def test_frequent_values_equal_the_count_of_all(spark, monkeypatch):
    n = 60_000
    i = F.col("id")
    # a column of values that are all different, one with values just at, below and above the share, and nulls
    df = spark.range(n).repartition(7).select(
        i.cast("string").alias("unique"),
        F.when(i < 3000, "at").when(i < 5999, "below").when(i < 9001, "above").when(i < 30000, None).otherwise(i.cast("string")).alias("mixed"),
        (i % 20).alias("even"), F.lit(None).cast("string").alias("none"), F.lit("").alias("empty"))
    sketched = frequent(df, df.columns, 0.05)
    assert sketched == {("mixed", "at", 3000), ("mixed", "above", 3002), ("empty", "", n)} | {("even", str(k), 3000) for k in range(20)}
    monkeypatch.setattr(stats, "MOST_TRACKED", 0)
    assert frequent(df, df.columns, 0.05) == sketched
    assert frequent(df, ["mixed"], 1 / n) == {(r.variable, r.value, r.n) for r in stats.value_counts(df, ["mixed"]).collect()}


def test_frequent_values_of_little(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "variable string, n int")
    assert frequent(df, ["variable", "n"], 0.5) == {("variable", "a", 2), ("n", "2", 2)}
    assert frequent(df, ["n"], 1.0) == frequent(df.limit(0), ["n"], 0.5) == set()
    with pytest.raises(ValueError):
        stats.frequent_values(df, ["n"], 0)


def test_rare_values_are_not_shuffled(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    counted = stats.frequent_values(df, ["v"], 0.05)
    counted.collect()

    def exchanges(plan):
        here = [plan.metrics().apply("shuffleRecordsWritten").value()] if plan.nodeName() == "Exchange" else []
        return sum((exchanges(c) for c in children(plan)), here)

    def children(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return [plan.executedPlan()]
        if "QueryStage" in plan.nodeName():
            return [plan.plan()]
        return [plan.children().apply(k) for k in range(plan.children().size())]
    written = exchanges(counted._jdf.queryExecution().executedPlan())
    assert written and max(written) < 1000


def test_multi_hot_and_first_items(spark):
    df = spark.createDataFrame([(1, "['Food']>IT>x>y"), (2, "IT")], "i int, l string")
    items = encode.first_items(df, "l", "ind", 3, {"IT": "computing"})
    assert [tuple(r)[2:] for r in items.orderBy("i").collect()] == [("Food", "computing", "x"), ("computing", None, None)]
    hot = encode.multi_hot(items, ["ind0", "ind1", "ind2"], ["Food", "computing"], "has").orderBy("i").collect()
    assert [(r.has_Food, r.has_computing) for r in hot] == [(1, 1), (0, 1)]


def test_rule_lists():
    assert list(rules.EDUCATION_TERMS) == ["diploma", "bachelors", "masters", "doctorate", "md", "rn", "jd"]
    assert rules.TIME_ZONES["egypt"] == "Africa/Cairo"


def test_stop_words_hold_contractions(spark):
    df = spark.createDataFrame([("don't touch they're kitchen",)], "x string")
    assert df.select(text.clean_tokens(F.col("x")).alias("t")).first().t == ["touch", "kitchen"]

from datetime import datetime

from pyspark.sql import functions as F

from adlake import rules
from adlake.operators import nested
from adlake.sources.schemas import SCHEMAS

ITEMS = "id int, section string, n int, a string, b string"


def test_nest_then_unnest_is_the_same(spark):
    items = [(1, "x", n, f"a{n}", None if n % 2 else f"b{n}") for n in range(25)] + [(2, "y", 0, "z", None)]
    df = spark.createDataFrame(items, ITEMS)
    docs = nested.nest_sections(df, "id", "section", "n", ["a", "b"])
    assert docs.filter("id = 1").count() == 1
    rows = nested.unnest_parts(docs, "id", "section", "n", ["a", "b"]).collect()
    want = {(i, s, n, f, v) for i, s, n, a, b in items for f, v in (("a", a), ("b", b)) if v is not None}
    assert {(r.id, r.section, r.n, r.field, r.text) for r in rows} == want
    assert len(rows) == len(want)
    summary = {r.id: (r["items"], r.first_a) for r in nested.section_summary(docs, "id", "section", "a").collect()}
    assert summary == {1: (25, "a0"), 2: (1, "z")}


def resumes(spark):
    def doc(uid, **fields):
        return {"id": uid, "downloaddate": datetime(2020, 1, 1), **fields}

    return spark.createDataFrame([
        doc(1, skills=["excel", "طبخ"], languages=[{"level": "good", "type": "Arabic"}],
            education=[{"degree": "BA", "description": None}, {"degree": None, "description": "x"}]),
        doc(2, summary="hello", experiences=[{"jobtitle": "cook"}]),
        doc(3),
    ], SCHEMAS["resumes"])


def test_unnest_resume(spark):
    long = nested.unnest_long(resumes(spark), ["id"], rules.TRANSLATED_FIELDS)
    got = {tuple(r) for r in long.collect()}
    assert got == {(1, "skills", "skills", 0, "excel"), (1, "skills", "skills", 1, "طبخ"),
                   (1, "languages", "type", 0, "Arabic"), (1, "education", "degree", 0, "BA"),
                   (1, "education", "description", 1, "x"), (2, "summary", "summary", 0, "hello"),
                   (2, "experiences", "jobtitle", 0, "cook")}


def test_translation_items(spark):
    long = nested.unnest_long(resumes(spark), ["id"], rules.TRANSLATED_FIELDS)
    glossary = spark.createDataFrame([("طبخ", "cooking"), ("excel", "WRONG")], "source string, target string")
    done = nested.translate_items(long, "text", glossary)
    assert {r.text: r.translated for r in done.filter("column1 = 'skills'").collect()} == {
        "excel": "excel", "طبخ": "cooking"}
    empty = nested.translate_items(long, "text", glossary.limit(0)).filter("needs").collect()
    assert [(r.text, r.translated) for r in empty] == [("طبخ", None)]
    left = nested.nothing_to_translate(resumes(spark), done.filter("needs"), ["id"])
    assert sorted(r.id for r in left.collect()) == [2, 3]


def test_sections_get_their_own_field_names(spark):
    cards = spark.createDataFrame([
        (1, "education", 0, "2015", "School", "BA", "Arts", None),
        (1, "experiences", 0, None, "Cook", "Inn", "Town", "d")],
        "id int, section string, listnum int, date string, subject string, item1 string, item2 string, description string")
    row = nested.resume_sections(cards, "id").first()
    assert (row.education[0].school, row.education[0].degree, row.education[0].major) == ("School", "BA", "Arts")
    assert (row.experiences[0].jobtitle, row.experiences[0].company, row.experiences[0].location) == ("Cook", "Inn", "Town")
    assert row.projects is None


def test_a_long_document_is_one_row(spark):
    cards = spark.range(2500).selectExpr(
        "1 AS id", "'education' AS section", "CAST(id AS INT) AS listnum", "'2015' AS date", "'s' AS subject",
        "'i' AS item1", "'j' AS item2", "'d' AS description")
    assert [len(r.education) for r in nested.resume_sections(cards, "id").collect()] == [2500]


def test_last_cell_of_a_repeated_key_counts(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],), ([],)], "e array<struct<key:string,value:string>>")
    columns = nested.kv_columns(F.col("e"), {"a": "x", "c": "y"})
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()] == [("3", None), (None, None)]

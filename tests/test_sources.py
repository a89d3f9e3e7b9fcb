import json
from datetime import date

from pyspark.sql import functions as F

from adlake.operators import combine, maintenance
from adlake.sources import tables
from adlake.sources.schemas import columns

KNOWN = columns("uid bigint, name string, loaded date")


def test_rejected_lines_and_good_rows_add_up(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text('uid,name,loaded\n1,"a, b",2020-01-01\nx,b,2020-01-02\n3,c\n4,,\n5,d,soon\n6,e,2020-01-03,more\n')
    (folder / "b.csv").write_text("uid,name,loaded\n")
    good, rejects = tables.scan_csv_checked(spark, str(folder), KNOWN)
    assert sorted((r.uid, r.name) for r in good.collect()) == [(1, "a, b"), (4, None)]
    assert sorted(r.line for r in rejects.collect()) == ["3,c", "5,d,soon", "6,e,2020-01-03,more", "x,b,2020-01-02"]
    assert all(r.file.endswith("a.csv") for r in rejects.collect())


def open_documents(spark, folder, docs):
    folder.mkdir(parents=True)
    (folder / "part.json").write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    return tables.scan_open_documents(spark, str(folder), KNOWN)


def test_documents_of_open_schema_go_through_load_upsert_and_back(spark, tmp_path):
    docs = [{"uid": 1, "name": "a", "loaded": "2020-01-01", "skills": [{"k": "é", "years": 2}], "odd key": {"x": None}},
            {"uid": 2, "name": {"first": "clash"}, "loaded": "2020-03-01"}, {"uid": "three", "name": "no number"},
            {"uid": 4, "error": "gone"}, {"uid": 5, "error": {"code": 1}}, {"uid": 6, "error": None, "loaded": "2020-03-01"}, "not json", "[1]", ""]
    loaded = open_documents(spark, tmp_path / "in", docs)
    assert sorted((str(r.uid), r.name) for r in loaded.select("uid", "name").collect()) == [
        ("1", "a"), ("2", '{"first":"clash"}'), ("6", None), ("None", "no number")]
    loaded.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored")).filter("uid IS NOT NULL")
    again = open_documents(spark, tmp_path / "in2", [{"uid": 1, "loaded": "2020-04-01", "new": [1.5, "x"]}, {"uid": 2, "loaded": "2020-04-01"}])
    after = maintenance.stale_upsert(stored, again, "uid", "loaded", date(2020, 4, 1), max_age_days=60)
    tables.write_open_documents(after, str(tmp_path / "out"))
    back = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda d: d["uid"])
    assert back == [{"uid": 1, "loaded": "2020-04-01", "new": [1.5, "x"]}, docs[1], docs[5]]


def laid_out(spark, path):
    rows = spark.range(2000).selectExpr("id AS uid", "concat('c', id % 5) AS country", "date_add(DATE '2020-01-01', CAST(id % 300 AS INT)) AS postdate",
                                        "date_format(date_add(DATE '2020-01-01', CAST(id % 300 AS INT)), 'yyyyMM') AS month")
    tables.write_table(rows, path, ["country", "month"])
    return spark.read.parquet(path)


def executed(df):
    query = df._jdf.queryExecution()
    query.toRdd().count()
    return query.executedPlan().toString().split("== Initial Plan ==")[0]


def test_partitions_are_pruned(spark, tmp_path):
    ads = laid_out(spark, str(tmp_path / "ads"))
    filters = executed(combine.preview(ads, "country", "c1", ["uid"], 5)).split("PartitionFilters: [")[1].split("]")[0]
    assert "country" in filters and "c1" in filters
    files = ads.filter("country = 'c1' AND month = 202003").select("_metadata.file_path").distinct().collect()
    assert files and all("country=c1/month=202003" in f[0] for f in files)
    marks = spark.createDataFrame([("c2", 1), ("c3", 2)], "country string, n int").filter("n > 1")
    marks.write.parquet(str(tmp_path / "marks"))
    due = spark.read.parquet(str(tmp_path / "marks")).filter("n > 1").select("country")
    plan = executed(ads.join(F.broadcast(due), "country").select("uid"))   # two rows
    assert "dynamicpruning" in plan

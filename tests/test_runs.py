from datetime import date, datetime, timedelta

from adlake import runs
from adlake.operators import page_records
from adlake.sources import tables as store
from adlake.sources.schemas import SCHEMAS

TODAY = date(2020, 6, 30)


def ago(days):
    return TODAY - timedelta(days)


def ad(uid, **fields):
    return {"country": "egypt", "uid": uid, "href": f"/ad/{uid}", **fields}


PAGE = "<span class='pdingleft10 brlefte5'>at 10:00, {}, Ad ID: 9</span><div class='pricelabel'>500</div>"


def test_load_run(spark, tmp_path):
    listing = spark.createDataFrame([ad(1, postdate=ago(7)), ad(2, postdate=ago(14)), ad(3, postdate=ago(3)),
                                     ad(4, postdate=ago(7)), ad(5, postdate=ago(98))], SCHEMAS["listing"])
    page = spark.createDataFrame(
        [{"country": "egypt", "uid": 4, "postdate": ago(7), "downloaddate": ago(2), "stat": "CLOSED"},
         {"country": "egypt", "uid": 1, "postdate": ago(7), "downloaddate": ago(2), "stat": "OPEN"}], SCHEMAS["page"])
    due = runs.due_ads(listing, page, TODAY)
    assert sorted(r.uid for r in due.collect()) == [1, 2, 5]
    fetched = due.selectExpr(
        "country", "uid", "postdate", "DATE '2020-06-30' AS downloaddate", "'12:00' AS downloadtime",
        f"CASE uid WHEN 1 THEN \"{PAGE.format(ago(7).strftime('%d %B %Y'))}\" WHEN 2 THEN '<p>gone' END AS html")
    made = runs.load_run(fetched, listing, page, str(tmp_path), TODAY)
    assert sorted((r.uid, r.stat) for r in made["archive"].collect()) == [(2, "CLOSED"), (4, "CLOSED"), (5, "NOT FOUND")]
    live = {(r.uid, r.downloaddate): r for r in made["page"].collect()}
    assert live.keys() == {(1, TODAY), (1, ago(2))}
    assert (live[1, TODAY].compensation, live[1, TODAY].posttime, live[1, TODAY].postdate) == (500, "10:00", ago(7))
    assert sorted(r.uid for r in made["listing"].collect()) == [1, 3]


def stamps(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_archive_run_writes_touched_partitions_alone(spark, tmp_path):
    def page(uid, country, stat, days):
        return {"country": country, "uid": uid, "postdate": ago(days), "downloaddate": ago(days), "stat": stat}

    pages = [page(1, "egypt", "OPEN", 3), page(1, "egypt", "CLOSED", 2), page(2, "egypt", "OPEN", 3), page(3, "jor dan", "OPEN", 200),
             page(4, "lebanon", "OPEN", 5), page(5, "lebanon", None, 5), page(6, None, "CLOSED", 5), page(7, None, "OPEN", 1)]
    ads = [{"country": c, "uid": u, "postdate": ago(3)} for u, c in
           ((1, "egypt"), (2, "egypt"), (3, "iraq"), (4, "lebanon"), (6, "tunis"), (8, "tunis"))]
    paths = [str(tmp_path / n) for n in ("page", "listing", "archive")]
    for rows, path, kind in ((pages, paths[0], "page"), (ads, paths[1], "listing")):
        store.write_table(spark.createDataFrame(rows, SCHEMAS[kind]), path, ["country"])
    before = stamps(tmp_path)
    done = runs.archive_run(spark, *paths, str(tmp_path / "work"), TODAY)
    assert done == {"page": 3, "listing": 3}

    def left(path):
        return sorted((r.uid, str(r.country)) for r in spark.read.parquet(path).collect())

    want = [(2, "egypt"), (4, "lebanon"), (5, "lebanon"), (7, "None")], [(2, "egypt"), (4, "lebanon"), (8, "tunis")], [
        (1, "egypt"), (1, "egypt"), (3, "jor dan"), (6, "None")]
    assert [left(p) for p in paths] == list(want)
    after = stamps(tmp_path)
    same = [f for f, t in before.items() if after.get(f) == t]
    assert same and all("country=lebanon" in f for f in same) and sum("country=lebanon" in f for f in before) == len(same)
    assert not (tmp_path / "page" / "country=jor dan").exists()
    # repeated, as after a failure: nothing changes, nothing is moved twice
    assert runs.archive_run(spark, *paths, str(tmp_path / "work"), TODAY) == done and [left(p) for p in paths] == list(want)
    # another day on which nothing is over
    assert runs.archive_run(spark, *paths, str(tmp_path / "work2"), TODAY) == {"page": 0, "listing": 0}
    assert [left(p) for p in paths] == list(want)


def test_job_board_run(spark, tmp_path):
    listing = spark.createDataFrame([{"country": "egypt", "uid": 1, "postdate": ago(7), "href": "/jobs/p/1-x"}],
                                    SCHEMAS["job_listing"])
    page = spark.createDataFrame([], SCHEMAS["job_page"])
    main = "<div class='job-main-card'><h1 class='job-title'>Cook</h1></div>"
    fetched = spark.createDataFrame([("egypt", 1, ago(7), TODAY, "12:00", main)],
                                    "country string, uid bigint, postdate date, downloaddate date, downloadtime string, html string")
    made = runs.load_run(fetched, listing, page, str(tmp_path), TODAY, table="job_page", parse=page_records.board_page)
    assert [(r.jobtitle, r.num_vacancies, r.postdate) for r in made["page"].collect()] == [("Cook", 1, ago(7))]
    assert made["archive"].count() == 0 and made["listing"].count() == 1


def test_list_run(spark, tmp_path):
    card = "<div class='new-time'><a href='/jobs/p/{0}-x'>x</a><time title='{1}'></time></div>"
    pages = spark.createDataFrame([("egypt", card.format(1, "Sunday, March 4, 2018 at 2:05PM")
                                    + card.format(2, "Monday, March 5, 2018 at 2:05PM")
                                    + card.format(3, "Monday, March 5, 2018 at 9:05AM"))], "country string, html string")
    stored = spark.createDataFrame([{"country": "egypt", "uid": 3, "postdate": date(2018, 3, 5)}], SCHEMAS["job_listing"])
    marks = spark.createDataFrame([("egypt", date(2018, 3, 5))], "country string, mark date")
    new = runs.list_run(page_records.board_cards(pages, ["country"]), stored, marks, str(tmp_path), date(2018, 3, 9), "job_listing")
    assert [(r.uid, r.href) for r in new.collect()] == [(2, "/jobs/p/2-x")]


def test_detail_run(spark, tmp_path):
    table = "<table class='job-details-table'><tr><th>Salary</th><td>1</td></tr></table>"
    fetched = spark.createDataFrame([("egypt", "a", table), ("egypt", "b", "<div class='alert-warning'>gone</div>")],
                                    "country string, uniqueid string, html string")
    summary = spark.createDataFrame([{"country": "egypt", "uniqueid": u} for u in "abc"], SCHEMAS["ad_summary"])
    made = runs.detail_run(fetched, summary, spark.createDataFrame([], SCHEMAS["ad_detail"]), str(tmp_path))
    assert [(r.uniqueid, r.salary) for r in made["detail"].collect()] == [("a", "1")]
    assert sorted(r.uniqueid for r in made["summary"].collect()) == ["a", "c"]


def test_people_run(spark, tmp_path):
    card = ("<div class='job-box panel-content clearfix'><a href='/profile/{0}?o=1'><h2 class='media-heading'>N</h2></a>"
            "<p>{1}</p><h4>Cook</h4><h5>Egypt - Cairo</h5></div>")
    fetched = spark.createDataFrame(
        [("Sales", "egypt", date(2020, 1, 1), 1, card.format(7, "Looking") + card.format(8, "Employed")),
         ("Sales", "egypt", date(2020, 1, 2), 1, card.format(7, "Employed"))],
        "srchtitle string, srchcountry string, day date, page int, html string")
    names = spark.createDataFrame([(0, "Employed")], "id int, jobstat string")
    made = runs.people_run(fetched, spark.createDataFrame([], SCHEMAS["resume_links"]), names, str(tmp_path))
    assert {r.jobstat: r.id for r in made["status_names"].collect()} == {"Employed": 0, "Looking": 1}
    got = {r.id: (r.jobstatid, r.country, r.region) for r in made["links"].collect()}
    assert got == {7: (1, "Egypt", "Cairo"), 8: (0, "Egypt", "Cairo")}


def test_analysis_run(spark, tmp_path):
    listing = spark.createDataFrame(
        [ad(n % 6, jobsector="ab"[n % 2], postdate=date(2020, 1 + n % 3, 1), i_photo=n % 2) for n in range(12)],
        SCHEMAS["listing"])
    made = runs.analysis_run(listing, listing, str(tmp_path), "uid", "jobsector", ["i_photo"], ["a", "b"])
    assert {r.cat: r.total for r in made["totals"].collect()} == {"a": 3.0, "b": 3.0}
    assert made["top_share"].first().top_pct == 100
    assert {r.variable: r.pct for r in made["missing_listing"].collect()}["region"] == 100.0
    assert made["pivot"].count() == 3
    assert {(r.jobsector, r.ads, r.i_photo) for r in made["summary"].collect()} == {("a", 6, 0.0), ("b", 6, 1.0)}


def test_resume_run(spark, tmp_path):
    def doc(uid, **fields):
        return {"id": uid, "downloaddate": datetime(2020, 1, 1), **fields}

    resumes = spark.createDataFrame([
        doc(1, gender="Female", nationality="x", birth_date="1990-01-01", marital_status="-", skills=["طبخ"],
            education=[{"degree": "BA"}], experiences=[{"jobtitle": "cook"}], last_active=ago(10),
            jobstatus=" Working but looking for new opportunities "),
        doc(2, gender="Male", nationality="x", birth_date="soon", marital_status="single"),
        doc(3, error="gone"),
    ], SCHEMAS["resumes"])
    links = spark.createDataFrame([{"id": i, "country": "egypt", "srchtitle": t} for i, t in
                                   [(1, "Sales"), (1, "Marketing"), (2, "Sales"), (9, "Cooks")]], SCHEMAS["resume_links"])
    glossary = spark.createDataFrame([("طبخ", "cooking")], "source string, target string")
    made = runs.resume_run(resumes, links, glossary, str(tmp_path), TODAY, group_size=1)
    available = {r.variable: r.pct for r in made["available"].collect()}
    assert (available["birth_date"], available["marital_status"], available["gender"]) == (50.0, 50.0, 100.0)
    users = made["users"].first()
    assert (users.age_mean, round(users.female, 3), round(users.employed, 3)) == (30.0, 0.333, 0.333)
    assert sorted(r.srchtitle for r in made["valid"].collect()) == ["Marketing", "Sales"]
    assert {(r.srchtitle, r.cnt) for r in made["links"].collect()} == {("Sales", 2), ("Marketing", 1)}
    assert "cooking" in {r.translated for r in made["translated"].collect()}
    assert [r.id for r in made["no_translation"].collect()] == [2]
    assert {r.months: r.share for r in made["active"].collect()}[1] == 0.5


RESUME_PAGE = """<title>Omar | site</title><div class='media profile-header'><h4 class='no-margin'>Cairo</h4><p>Working</p></div>
<div class='section-block'><div class='panel-header listing-header'><h2>Personal Information</h2></div><div class='row'>
<div class='col-md-6 col-sm-6'>Gender: Male</div><div class='col-md-6 col-sm-6'>Nationality: Egypt</div>
<div class='col-md-6 col-sm-6'>Nationality: Oman</div></div></div>
<div class='section-block'><div class='panel-header listing-header'><h2>Experiences</h2></div><div class='row'>
<li style='position:relative;'><div class='date'>Mar 2015 - May 2016</div><div class='subject'>Cook</div><p>Inn | Town</p></li></div></div>
<div class='section-block'><div class='panel-header listing-header'><h2>Education</h2></div><div class='row'>
<li style='position:relative;'><div class='date'>2011</div><div class='subject'>School</div><p>BA | Arts</p></li></div></div>"""


def test_load_resumes_from_page_to_report(spark, tmp_path):
    day = datetime(2020, 6, 1)
    fetched = spark.createDataFrame([(1, day, RESUME_PAGE), (2, day, "<title>x</title>"), (3, day, RESUME_PAGE), (9, day, RESUME_PAGE)],
                                    "id bigint, downloaddate timestamp, html string")
    stored = spark.createDataFrame([{"id": 3, "downloaddate": datetime(2020, 5, 30), "gender": "Female"}], SCHEMAS["resumes"])
    links = spark.createDataFrame([{"id": i, "srchtitle": "Sales", "country": "egypt"} for i in (1, 2, 3, 4)], SCHEMAS["resume_links"])
    for _ in range(2):  # a repeated run changes nothing
        made = runs.load_resumes(fetched, stored, links, str(tmp_path / "load"), date(2020, 6, 1))
    docs = {r.id: r for r in made["documents"].collect()}
    assert set(docs) == {1, 2, 3} and [r.id for r in made["missing"].collect()] == [4]
    one = docs[1]
    assert (one.gender, one.nationality, one.personal, one.jobstatus) == ("Male", "Oman", {"Gender": "Male", "Nationality": "Oman"}, "Working")
    assert tuple(one.experiences[0]) == (date(2015, 3, 1), date(2016, 5, 1), "Cook", "Inn", "Town", None)
    assert tuple(one.education[0]) == ("2011", "School", "BA", "Arts", None)
    assert docs[2].error == "profile is deactivated" and docs[3].gender == "Female"
    assert spark.read.parquet(str(tmp_path / "load/raw")).count() == 3
    glossary = spark.createDataFrame([], "source string, target string")
    report = runs.resume_run(made["documents"], links, glossary, str(tmp_path / "report"), date(2020, 6, 1), group_size=0)
    assert report["links"].collect()[0]["cnt"] == 4


def test_store_translations(spark, tmp_path):
    schema = "id bigint, downloaddate timestamp, column1 string, column2 string, listnum int, text string, needs boolean, translated string"
    day = datetime(2020, 6, 1)
    items = spark.createDataFrame([(1, day, "a", "a", 0, "x", True, "new"), (1, day, "a", "a", 1, "y", True, None), (2, day, "a", "a", 0, "z", False, "z"),
                                   (3, day, "a", "a", 0, "x", True, "other")], schema)
    stored = spark.createDataFrame([{"id": 3, "downloaddate": day.date(), "column1": "a", "column2": "a", "listnum": 0,
                                     "translation_en": "old"}], SCHEMAS["translations"])
    assert [(r.id, r.translation_en) for r in runs.store_translations(items, stored, str(tmp_path)).collect()] == [(1, "new")]


def test_several_categories_of_an_ad_share_its_weight(spark, tmp_path):
    listing = spark.createDataFrame([("egypt", 1, "['IT']>Food", date(2020, 1, 1)), ("egypt", 2, "IT", date(2020, 1, 5)), ("egypt", 3, None, date(2020, 1, 5))],
                                    "country string, uid bigint, industries string, postdate date")
    made = runs.analysis_run(listing, listing, str(tmp_path), "uid", "industries", [], several=True)
    assert {r.cat: r.total for r in made["totals"].collect()} == {"IT": 1.5, "Food": 0.5, None: 1.0}


def test_classified_features(spark, tmp_path):
    listing = spark.createDataFrame([{"country": "egypt", "uid": i, "postdate": date(2020, 1, 1), "jobsector": "Jobs Wanted" if i == 3 else "IT",
                                      "i_photo": 1, "i_featured": 0} for i in (1, 2, 3)], SCHEMAS["listing"])
    page = spark.createDataFrame([{"country": "egypt", "uid": i, "postdate": date(2020, 1, 1), "downloaddate": date(2020, 1, d),
                                   "employtype": "Full-time" if i == 1 else None, "compensation": 50 * i, "pageviews": d} for i in (1, 2, 3) for d in (5, 9)],
                                 SCHEMAS["page"])
    made = runs.classified_features(listing, page, str(tmp_path), exclude=["Jobs Wanted"])
    rows = {r.uid: r for r in made["features"].collect()}
    assert set(rows) == {1, 2} and (rows[1].daysposted, rows[1].fulltime, rows[1].comp, rows[2].comp) == (8, 1, None, 100.0)
    assert rows[1]["employtype_Full-time"] == 1 and rows[2]["employtype_Full-time"] == 0
    (summary,) = made["summary"].collect()
    assert (summary.ads, summary.pageviews, summary.fulltime, summary.i_photo) == (2, 9.0, 0.5, 1.0)


def test_board_features(spark, tmp_path):
    page = spark.createDataFrame([{"country": "egypt", "uid": i, "postdate": date(2020, 1, 1), "downloaddate": date(2020, 1, 3), "company": f"c{i}",
                                   "experience_needed": "2 to 4 years", "vacancies": "3 open positions", "location": "Maadi, Cairo, Egypt",
                                   "requirements": "Bachelor degree>excel and problem solving", "industries": "['IT']>Food" if i else "Food",
                                   "education_level": None} for i in (0, 1)], SCHEMAS["job_page"])
    listing = spark.createDataFrame([{"country": "egypt", "uid": 1, "postdate": date(2020, 1, 1), "href": "/x"}], SCHEMAS["job_listing"])
    names = spark.createDataFrame([("c1", "One")], "k string, v string")
    made = runs.board_features(listing, page, str(tmp_path), names)
    row = {r.uid: r for r in made["features"].collect()}[1]
    assert (row.expmin, row.expmax, row.vacancies, row.req_num, row.req_bachelors, row.province) == (2, 4, 3, 2, 1, "Cairo")
    assert (row.company, row.ind0, row.ind1, row.industry_IT, row.industry_Food, row.education_level) == ("One", "IT", "Food", 1, 1, "bachelors")
    assert made["summary"].count() == 2 and made["profile"].first().expmin_count == 2

"""The known page kinds. The given pages hold none of them, so each query writes one page
per row of a table and reads it back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from adlake.operators import page_records
from adlake.plans import roles
from adlake.plans.registry import query
from adlake.plans.roles import LISTING, POSTINGS, TODAY


def spread_rows(t, df, key):
    # Parsing costs far more than moving these few columns, so they are spread by a fixed
    # number: AQE would merge partitions by their small size.
    return df.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), key)


def ads(t):
    return spread_rows(t, roles.listing(t), "uid")


def people(t):
    return spread_rows(t, roles.places(t), "c_custkey")


PEOPLE = """people AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""


def one(c, value):
    return F.col(c) == value


MARCH = date(2001, 3, 15)


@query("classified_cards", """SELECT c_custkey AS page_id, c_custkey + 1000 AS uid, c_name || '.html' AS href,
        DATE '2001-03-14' AS postdate, CAST(c_mktsegment <> 'BUILDING' AS INTEGER) AS i_photo,
        CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS i_featured FROM customer
    UNION ALL SELECT c_custkey, c_custkey + 2000, c_name, DATE '2000-11-05', 1::INTEGER, 0::INTEGER
    FROM customer WHERE c_acctbal > 0""")
def classified_cards(t):
    photo = F.when(one("c_mktsegment", "BUILDING"), "/img/jobs-services-thumb.png").otherwise("/img/1.jpg")
    paid = F.when(one("c_mktsegment", "HOUSEHOLD"), "<span class='ads__item__paidicon icon paid'></span>").otherwise("")
    second = F.when(F.col("c_acctbal") > 0, "data-statkey='ad.observed.list'").otherwise("")
    page = F.format_string(
        "<html><body><div class='ads__item__photos-holder'><img src='%s'>%s"
        "<a class='fav link {id:%d}' data-statkey='ad.observed.list'>*</a></div>"
        "<div class='ads__item__info'><a class='ads__item__title x' href='https://site.test/en/ad/%s.html'>"
        "Cook</a><p class='ads__item__date'> Yesterday 11:20 </p></div>"
        "<div class='ads__item__photos-holder'><img src='a.png'><a class='fav link {id:%d}' %s>*</a></div>"
        "<div class='ads__item__info'><a class='ads__item__title' href='/ad/%s'>Baker</a>"
        "<p class='ads__item__date'>5 Nov</p></div></body></html>",
        photo, paid, F.col("c_custkey") + 1000, F.col("c_name"), F.col("c_custkey") + 2000, second, F.col("c_name"))
    pages = spread_rows(t, t.customer, "c_custkey").select(F.col("c_custkey").alias("page_id"), page.alias("html"))
    return page_records.classified_cards(pages, ["page_id"], MARCH)


@query("summary_cards", f"""WITH {LISTING} SELECT uid AS page_id, 'u' || uid AS uniqueid, CAST(uid AS INTEGER) AS dataid,
    CAST(level = '1-URGENT' AS INTEGER) AS i_featured, CASE WHEN stat <> 'CLOSED' THEN postdate END AS postdate,
    category AS title, '/jobs/' || uid AS href, CASE WHEN stat = 'OPEN' THEN region END AS company,
    level || chr(10) || country AS description FROM listing""")
def summary_cards(t):
    return page_records.summary_cards(summary_pages(t).select("page_id", "html"), ["page_id"])


def summary_pages(t):
    """One page an ad, with the ad's page_id, country, cat and subcat."""
    company = F.when(one("stat", "OPEN"), F.concat(F.lit("<a href='#'>"), "region", F.lit("</a>"))).otherwise("")
    when = F.when(one("stat", "CLOSED"), "some time").otherwise(F.date_format("postdate", "d MMMM yyyy"))
    page = F.format_string(
        "<html><body><div id='jobs_list'><div data-id='u%d' id='job-%d' class='card %s'>"
        "<a href='/jobs/%d'> %s </a><div class='meta-desc'>%s posted %s</div><p>%s\n\t--\n %s </p></div></div>"
        "<div id='other'><a href='/x'>x</a></div></body></html>",
        F.col("uid"), F.col("uid"), F.when(one("level", "1-URGENT"), "featured_job").otherwise(""),
        F.col("uid"), F.col("category"), company, when, F.col("level"), F.col("country"))
    return ads(t).select(F.col("uid").alias("page_id"), "country", F.col("category").alias("cat"),
                         F.col("region").alias("subcat"), page.alias("html"))


@query("board_cards", f"""WITH {POSTINGS} SELECT uid AS page_id, uid, CASE WHEN level = '5-LOW'
        THEN '/internship/' ELSE '/jobs/p/' END || uid || '-cook' AS href,
    strftime(postdate, '%A, %B ') || day(postdate) || strftime(postdate, ', %Y at 2:05PM') AS postdatetime, postdate
    FROM postings""")
def board_cards(t):
    page = F.format_string(
        "<html><body><div class='content-card card-has-jobs'><div class='new-time'><a href='%s%d-cook?o=1'>Cook</a>"
        "<time title='%s at 2:05PM'>now</time></div></div></body></html>",
        F.when(one("level", "5-LOW"), "/internship/").otherwise("/jobs/p/"), F.col("uid"),
        F.date_format("postdate", "EEEE, MMMM d, yyyy"))
    rows = spread_rows(t, roles.postings(t), "uid")
    return page_records.board_cards(rows.select(F.col("uid").alias("page_id"), page.alias("html")), ["page_id"])


@query("resume_cards", f"""WITH {PEOPLE} SELECT c_custkey AS page_id, c_custkey AS id, c_name AS name,
    c_mktsegment AS jobstat, 'Cook & Co' AS jobtitle, r_name AS country,
    CASE WHEN c_acctbal > 0 THEN n_name END AS region FROM people""")
def resume_cards(t):
    place = F.when(F.col("c_acctbal") > 0, F.concat("r_name", F.lit(" - "), "n_name")).otherwise(F.col("r_name"))
    page = F.format_string(
        "<html><body><div class='job-box panel-content clearfix'><a href='/profile/%d?open=1'>"
        "<h2 class='media-heading'> %s</h2></a><p> %s </p><h4>Cook &amp; Co</h4><h5>%s</h5></div></body></html>",
        F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), place)
    return page_records.resume_cards(
        people(t).select(F.col("c_custkey").alias("page_id"), page.alias("html")), ["page_id"])


@query("region_counts", """SELECT p_partkey AS page_id, p_brand AS region, replace(lower(p_brand), '#', '#') AS freg,
        p_size * 1000 AS totalregposts, p_name AS subregion, replace(p_name, ' ', '-') AS fsubreg,
        p_size AS subposts FROM part
    UNION ALL SELECT p_partkey, p_brand, lower(p_brand), p_size * 1000, p_type || ' + Side',
        lower(p_type) || '-side', 2::INTEGER FROM part""")
def region_counts(t):
    page = F.format_string(
        "<html><body><div class='content text'><div class='bgef pding5_10 marginbott10 margintop20 clr'>%s (%s)</div>"
        "<div class='clr marginbott10'><ul><li>%s\n (%d)</li><li>%s + Side (2)</li></ul></div></div></body></html>",
        F.col("p_brand"), F.format_number(F.col("p_size") * 1000, 0), F.col("p_name"), F.col("p_size"), F.col("p_type"))
    rows = spread_rows(t, t.part, "p_partkey")
    return page_records.region_counts(rows.select(F.col("p_partkey").alias("page_id"), page.alias("html")), ["page_id"])


@query("sector_counts", """SELECT p_partkey AS page_id, p_type AS sector, '/' || lower(p_type) || '/' AS href,
        p_size * 1000 AS totalposts FROM part
    UNION ALL SELECT p_partkey, p_brand, '/b/', 7::INTEGER FROM part""")
def sector_counts(t):
    link = ("<a class='topLink tdnone ' href='%s'><span class='link'><span> %s</span></span>"
            "<span class='counter nowrap'>%s</span></a>")
    page = F.format_string(
        f"<html><body><div class='wrapper'>{link}{link}<a href='/no'>no</a></div></body></html>",
        F.concat(F.lit("/"), F.lower("p_type"), F.lit("/")), F.col("p_type"),
        F.format_number(F.col("p_size") * 1000, 0), F.lit("/b/"), F.col("p_brand"), F.lit("7"))
    rows = spread_rows(t, t.part, "p_partkey")
    return page_records.sector_counts(rows.select(F.col("p_partkey").alias("page_id"), page.alias("html")), ["page_id"])


@query("classified_page", f"""WITH {PEOPLE}, p AS (SELECT *, c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AS live FROM people)
    SELECT c_custkey AS page_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'NOT FOUND' WHEN 'FURNITURE' THEN 'CLOSED'
        ELSE 'OPEN' END AS stat,
    CASE WHEN live THEN c_custkey END AS adid, CASE WHEN live THEN DATE '2018-03-04' END AS postdate,
    CASE WHEN live THEN '14:05' END AS posttime, CASE WHEN live THEN 'Cook' END AS title,
    CASE WHEN live THEN n_name END AS experiencelevel, CAST(NULL AS VARCHAR) AS educationlevel,
    CASE WHEN live THEN 'Job Seeker' END AS type, CAST(NULL AS VARCHAR) AS employtype,
    CASE WHEN live THEN 'First line>' || r_name END AS description,
    CASE WHEN live THEN c_nationkey END AS pageviews,
    CASE WHEN live THEN CAST(floor(abs(c_acctbal)) AS BIGINT) END AS compensation,
    CASE WHEN live THEN '/user/' || c_custkey END AS userhref, CASE WHEN live THEN c_name END AS username,
    CASE WHEN live THEN 2015::INTEGER END AS userjoinyear, CASE WHEN live THEN 'Mar' END AS userjoinmt,
    CASE WHEN live THEN 1::INTEGER END AS emailavail,
    CASE WHEN live THEN CAST(c_acctbal > 0 AS INTEGER) END AS phoneavail FROM p""")
def classified_page(t):
    page = F.format_string(
        "<html><body><span class='pdingleft10 brlefte5'>Added at 14:05, 4 March 2018, Ad ID: %d </span>"
        "<div class='clr offerheadinner pding15 pdingright20'><h1>Cook</h1></div>"
        "<div class='clr' id='textContent'> First line\n%s </div><div class='clr descriptioncontent marginbott20'>"
        "<table><tr><td class='col'><table><tr><th>Experience Level</th><td> %s </td></tr></table></td>"
        "<td class='col'><table><tr><th>Type</th><td>Job Seeker</td></tr></table></td></tr></table></div>"
        "<div class='pdingtop10'>Views:<strong>%d</strong></div>"
        "<div class='pricelabel tcenter'><strong>%s - 99,999 EGP</strong></div>"
        "<div class='user-box'><a href='/user/%d'>u</a><p class='user-box__info__name'> %s </p>"
        "<p class='user-box__info__age'>On site since Mar 2015</p></div>"
        "<div class='contactbox innerbox br3 bgfff rel'>Email Seller</div>"
        "<div class='contactbox-indent rel brkword'>%s</div></body></html>",
        F.col("c_custkey"), F.col("r_name"), F.col("n_name"), F.col("c_nationkey"),
        F.format_number(F.floor(F.abs("c_acctbal")), 0), F.col("c_custkey"), F.col("c_name"),
        F.when(F.col("c_acctbal") > 0, "Show phone").otherwise("none"))
    html = F.when(one("c_mktsegment", "BUILDING"), None).when(
        one("c_mktsegment", "FURNITURE"), "<html><body>This ad is gone</body></html>").otherwise(page)
    return page_records.classified_page(
        people(t).select(F.col("c_custkey").alias("page_id"), html.alias("html")), ["page_id"])


@query("board_page", f"""WITH {PEOPLE}, p AS (SELECT *, c_mktsegment <> 'BUILDING' AS found,
        CAST(floor(abs(c_acctbal)) AS INTEGER) AS n FROM people)
    SELECT c_custkey AS page_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'NOT FOUND' WHEN 'FURNITURE' THEN 'CLOSED'
        ELSE 'OPEN' END AS stat,
    CASE WHEN found THEN DATE '2018-03-04' END AS postdate, CASE WHEN found THEN '14:05' END AS posttime,
    CASE WHEN found THEN 'Cook' END AS jobtitle, CASE WHEN found THEN c_name END AS company,
    CASE WHEN found THEN n_name || ', ' || r_name END AS location,
    CASE WHEN found THEN CASE WHEN c_acctbal > 0 THEN n ELSE 0 END END AS num_applicants,
    CASE WHEN found THEN 1::INTEGER END AS num_vacancies, CASE WHEN found THEN n END AS num_seen,
    CASE WHEN found THEN 3::INTEGER END AS num_shortlisted, CASE WHEN found THEN 0::INTEGER END AS num_rejected,
    CASE WHEN found THEN '2 to 4 years' END AS experience_needed, CAST(NULL AS VARCHAR) AS career_level,
    CAST(NULL AS VARCHAR) AS job_type,
    CASE WHEN found THEN CASE WHEN c_acctbal > 0 THEN n || ' EGP' ELSE '1,000, Negotiable' END END AS salary,
    CAST(NULL AS VARCHAR) AS education_level, CAST(NULL AS VARCHAR) AS gender,
    CAST(NULL AS VARCHAR) AS travel_frequency, CASE WHEN found THEN 'English>Arabic' END AS languages,
    CASE WHEN found THEN '5 open positions' END AS vacancies, CASE WHEN found THEN 'Cooking>' || n_name END AS roles,
    CASE WHEN found THEN 'cook>' || lower(c_mktsegment) END AS keywords,
    CASE WHEN found THEN 'good cook>clean, tidy ' || lower(r_name) END AS requirements,
    CASE WHEN found THEN 'Food & Drink>' || c_mktsegment END AS industries FROM p""")
def board_page(t):
    n = F.format_number(F.floor(F.abs("c_acctbal")), 0)
    digits = F.floor(F.abs("c_acctbal")).cast("int")
    page = F.format_string(
        "<html><body>%s<div class='job-main-card content-card'><h1 class='job-title'> Cook </h1>"
        "<a class='job-company-name'>%s</a><span class='job-company-location'>%s, %s</span>%s"
        "<div class='applicants-stat-num'>%d</div><div class='applicants-stat-num'>3</div>"
        "<p class='job-post-date' title='Sunday, March 4, 2018 at 2:05PM'>1 day</p></div>"
        "<div class='row job-summary'><dl><dt>Experience Needed:</dt><dd> 2 to 4\n years</dd></dl>"
        "<dl><dt>Salary:</dt><dd>%s</dd></dl><dl><dt>Languages:</dt><dd>English,Arabic</dd></dl>"
        "<dl><dt>Vacancies:</dt><dd>5 open positions</dd></dl></div>"
        "<div class='about-job content-card'><div class='labels-wrapper'><a>Cooking </a><a>%s</a></div></div>"
        "<div class='job-requirements content-card'><meta content='cook, %s'><ul><li>Good cook.</li>"
        "<li>Clean, tidy; %s.</li></ul></div>"
        "<div class='industries labels-wrapper'><a>Food &amp; Drink</a><a>%s</a></div></body></html>",
        F.when(one("c_mktsegment", "FURNITURE"), "<div class='alert alert-danger alert-job col-sm-12'>x</div>").otherwise(""),
        F.col("c_name"), F.col("n_name"), F.col("r_name"),
        F.when(F.col("c_acctbal") > 0, F.format_string("<div class='applicants-num'>%d</div>", digits)).otherwise(""),
        digits, F.when(F.col("c_acctbal") > 0, F.concat(n, F.lit(" EGP"))).otherwise("1,000, Negotiable"),
        F.col("n_name"), F.lower("c_mktsegment"), F.col("r_name"), F.col("c_mktsegment"))
    html = F.when(one("c_mktsegment", "BUILDING"), None).otherwise(page)
    return page_records.board_page(
        people(t).select(F.col("c_custkey").alias("page_id"), html.alias("html")), ["page_id"])


@query("ad_details", f"""WITH {LISTING} SELECT uid, postdate, region AS location, level AS jobtype,
    CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS reqexp,
    CASE WHEN stat = 'OPEN' THEN 'R&D' ELSE stat END AS salary, CAST(NULL AS VARCHAR) AS education,
    category AS title, 'thumb/' || country || '.png' AS pubimg, 'What:' || chr(10) || category AS description
    FROM listing WHERE stat <> 'NOT FOUND'""")
def ad_details(t):
    salary = F.when(one("stat", "OPEN"), "R&amp;D").otherwise(F.col("stat"))
    page = F.format_string(
        "<html><body><h1 class='logo'>x</h1><h1> %s </h1><table class='table job-details-table'>"
        "<tr><th>Posted date</th><td>%s (new)</td></tr><tr><th> Location</th>\n<td>\t%s </td></tr>"
        "<tr><th>Job Type</th><td>%s</td></tr><tr><th>Salary</th><td>-</td></tr><tr><th>Salary</th><td>%s</td></tr>"
        "<tr><th>Publisher</th><td><img src='/i/thumb/%s.png'></td></tr></table>"
        "<div class='job-details'>\n\tWhat: \n\n -- \n<!-- note -->%s</div></body></html>",
        F.col("category"), F.date_format("postdate", "d MMMM yyyy"), F.col("region"), F.col("level"), salary,
        F.col("country"), F.col("category"))
    html = F.when(one("stat", "NOT FOUND"), "<html><body>gone</body></html>").otherwise(page)
    return page_records.ad_details(ads(t).select("uid", html.alias("html")), ["uid"])


@query("dead_pages", """SELECT c_custkey AS page_id FROM customer WHERE c_mktsegment = 'BUILDING'""")
def dead_pages(t):
    html = (F.when(one("c_mktsegment", "BUILDING"), "<div class='alert alert-warning'>gone</div>")
            .when(one("c_mktsegment", "FURNITURE"), "<p>empty</p>")
            .otherwise("<div class='alert alert-warning'>!</div><table class='table job-details-table'></table>"))
    pages = spread_rows(t, t.customer, "c_custkey").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    return page_records.dead_pages(pages, ["page_id"])


@query("resume_page", f"""WITH {PEOPLE} SELECT c_custkey AS id, c_name AS name, 1::INTEGER AS has_photo,
    CASE WHEN gone THEN 'profile is deactivated' END AS error, CASE WHEN NOT gone THEN n_name END AS location,
    CASE WHEN NOT gone THEN 'Chef' END AS title, CASE WHEN NOT gone THEN DATE '2001-07-31' END AS last_active,
    CASE WHEN NOT gone THEN r_name END AS nationality, CASE WHEN NOT gone THEN 2::INTEGER END AS schools,
    CASE WHEN NOT gone THEN 'School of ' || n_name END AS school, CASE WHEN NOT gone THEN 2015::INTEGER END AS school_year,
    CASE WHEN NOT gone THEN 'BA' END AS degree, CASE WHEN NOT gone THEN 'Arts' END AS major,
    CASE WHEN NOT gone THEN 'Cook' END AS jobtitle, CASE WHEN NOT gone THEN DATE '2015-03-01' END AS job_start,
    CASE WHEN NOT gone THEN DATE '2001-08-01' END AS job_end, CASE WHEN NOT gone THEN 'Kitchen work' END AS duties,
    CASE WHEN NOT gone THEN 'Cooking>' || c_mktsegment END AS skills,
    CASE WHEN NOT gone THEN 'Arabic' END AS language, CASE WHEN NOT gone THEN 'I cook.' END AS summary
    FROM (SELECT *, c_mktsegment = 'BUILDING' AS gone FROM people)""")
def resume_page(t):
    docs = page_records.resume_page(resume_pages(t), ["id"], TODAY)
    # What a profile that is gone still shows is not part of the check.
    live = F.col("error").isNull()
    school, job = F.get("education", 0), F.get("experiences", 0)
    shown = {
        "nationality": F.get("personal", 0)["value"], "schools": F.size("education"), "school": school["school"],
        "school_year": school["date"]["year"], "degree": school["degree"], "major": school["major"],
        "jobtitle": job["jobtitle"], "job_start": job["date"]["start"], "job_end": job["date"]["end"],
        "duties": job["description"], "skills": F.array_join("skills", ">"),
        "language": F.get("languages", 0)["type"], "summary": F.col("summary"),
    }
    return docs.select("id", "name", "has_photo", "error", "location", "title", "last_active",
                       *[F.when(live, c).alias(n) for n, c in shown.items()])


def resume_pages(t):
    """One resume a customer: (id, html)."""
    header = F.format_string(
        "<div class='media profile-header'><h4 class='no-margin'>%s</h4><h4>Chef</h4><p>Looking</p>"
        "<p>Last Active: Yesterday</p></div>", F.col("n_name"))

    def block(heading, content):
        return (f"<div class='section-block'><div class='panel-header listing-header'><h2>{heading}</h2></div>"
                f"<div class='row'>{content}</div></div>")

    item = ("<li style='position:relative;'><div class='date'>%s</div><div class='subject'>%s</div>"
            "<p>%s</p><div class='col-md-10'>%s</div></li>")
    page = F.format_string(
        "<html><head><title>%s | site</title></head><body><div class='media-left biothumb'><img src='/me.png'></div>%s"
        + block("Personal Information", "<div class='col-md-6 col-sm-6'>Nationality: %s</div>")
        + block("Education", "<ul>" + item.replace("%s</div></li>", "</div></li>") + item + "</ul>")
        + block("Experiences", "<ul>" + item + "</ul>")
        + block("Skills", "<button> Cooking</button><button>%s</button>")
        + block("Languages", "<ul><li><div class='dates'>native</div><div class='lang'>Arabic</div></li></ul>")
        + block("Summary", " I cook. ") + "</body></html>",
        F.col("c_name"), F.when(one("c_mktsegment", "BUILDING"), "").otherwise(header), F.col("r_name"),
        F.lit("2015"), F.concat(F.lit("School of "), "n_name"), F.lit("BA | Arts"),
        F.lit("May 2011"), F.lit("High school"), F.lit("diploma"), F.lit("diploma"),
        F.lit("Mar 2015 - Present"), F.lit("Cook"), F.lit("Inn | Town"), F.lit("Kitchen work"), F.col("c_mktsegment"))
    return people(t).select(F.col("c_custkey").alias("id"), page.alias("html"))

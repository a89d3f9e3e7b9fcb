"""Declared schemas of the ad and resume tables.

Column names, order and types are fixed values. Dates are real dates, 0/1 flags stay
integers because they are averaged, and text has no length limit. ``KEYS`` names the
columns that identify a row of each table.
"""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
         "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def columns(text: str) -> T.StructType:
    """Schema of 'name type, name type'. Needs no running session, unlike fromDDL."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


def _items(text: str) -> T.ArrayType:
    return T.ArrayType(columns(text))


SCHEMAS = {
    # classified ads: counts by region, listing and daily page snapshots
    "region_counts": columns(
        "downloaddate date, downloadtime string, country string, region string, freg string, "
        "subregion string, fsubreg string, totalregposts int, subposts int"
    ),
    "region_sector_counts": columns(
        "downloaddate date, downloadtime string, country string, region string, freg string, "
        "subregion string, fsubreg string, sector string, href string, totalposts int"
    ),
    "listing": columns(
        "country string, region string, freg string, subregion string, fsubreg string, "
        "jobsector string, postdate date, uid bigint, i_photo int, i_featured int, href string"
    ),
    "page": columns(
        "downloaddate date, downloadtime string, country string, uid bigint, postdate date, "
        "posttime string, pageviews int, title string, experiencelevel string, "
        "educationlevel string, type string, employtype string, compensation bigint, "
        "description string, textlanguage string, userhref string, username string, "
        "userjoinyear int, userjoinmt string, emailavail int, phoneavail int, stat string"
    ),
    # job board: listing and page with applicant counts
    "job_listing": columns(
        "country string, uid bigint, href string, postdatetime string, postdate date"
    ),
    "job_page": columns(
        "country string, uid bigint, postdate date, posttime string, downloaddate date, "
        "downloadtime string, stat string, jobtitle string, company string, location string, "
        "num_applicants int, num_vacancies int, num_seen int, num_shortlisted int, "
        "num_rejected int, experience_needed string, career_level string, job_type string, "
        "salary string, education_level string, gender string, travel_frequency string, "
        "languages string, vacancies string, roles string, keywords string, "
        "requirements string, industries string"
    ),
    # ad aggregator: category links, summaries, details, translations
    "main_links": columns(
        "downloaddate date, country string, topic string, cat string, href string, img string"
    ),
    "category_links": columns(
        "downloaddate date, country string, cat string, subcat string, href string"
    ),
    "ad_summary": columns(
        "country string, cat string, subcat string, uniqueid string, dataid int, "
        "i_featured int, postdate date, title string, href string, description string"
    ),
    "ad_detail": columns(
        "country string, uniqueid string, postdate date, location string, jobtype string, "
        "company string, reqexp string, salary string, education string, title string, "
        "pubimg string, description string"
    ),
    "ad_translation": columns("country string, uniqueid string, description_en string"),
    # resumes: search results, status names, documents, translations
    "resume_links": columns(
        "id bigint, srchtitle string, srchcountry string, name string, jobtitle string, "
        "jobstatid int, country string, region string"
    ),
    "status_names": columns("id int, jobstat string"),
    "resumes": columns(
        "id bigint, downloaddate timestamp, error string, gender string, nationality string, "
        "jobstatus string, marital_status string, birth_date string, last_active date"
    )
    .add("education", _items("date string, school string, degree string, major string, "
                             "description string"))
    .add("experiences", _items("date_start date, date_end date, jobtitle string, "
                               "company string, location string, description string"))
    .add("projects", _items("date string, name string, item1 string, item2 string, "
                            "description string"))
    .add("skills", T.ArrayType(T.StringType()))
    .add("languages", _items("level string, type string"))
    .add("summary", T.StringType())
    .add("personal", T.MapType(T.StringType(), T.StringType())),
    "translations": columns(
        "id bigint, downloaddate date, column1 string, column2 string, listnum int, "
        "translation_en string"
    ),
    "no_translation": columns("id bigint, downloaddate date"),
}

KEYS = {
    "region_counts": ["downloaddate", "region", "subregion"],
    "region_sector_counts": ["downloaddate", "region", "subregion", "sector"],
    "listing": ["uid", "postdate"],
    "page": ["downloaddate", "uid", "postdate"],
    "job_listing": ["uid", "postdate"],
    "job_page": ["uid", "postdate", "downloaddate"],
    "main_links": ["country", "href"],
    "category_links": ["country", "href"],
    "ad_summary": ["uniqueid", "postdate"],
    "ad_detail": ["country", "uniqueid", "postdate"],
    "ad_translation": ["country", "uniqueid"],
    "resume_links": ["id", "srchtitle", "country"],
    "status_names": ["id"],
    "resumes": ["id"],
    "translations": ["id", "downloaddate", "column1", "column2", "listnum"],
    "no_translation": ["id", "downloaddate"],
}

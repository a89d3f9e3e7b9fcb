"""Dates found in pages and resumes. ``today`` is always a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions.text import capture_int, let, strip


def month_number(name: Column) -> Column:
    """Month name or its first three letters as 1 to 12, else null."""
    numbers = {}
    for i, month in enumerate(rules.MONTHS, 1):
        numbers[month.lower()] = numbers[month[:3].lower()] = i
    table = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers; null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"),
                                     F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def relative_date(c: Column, today: date) -> Column:
    """'Today', 'Yesterday' or 'dd Mon'; a month after today's is last year's."""
    now = F.lit(today)
    month = month_number(F.regexp_extract(c, r"(\d+)\s+(\w+)", 2))
    year = F.when(month <= today.month, today.year).otherwise(today.year - 1)
    return (
        F.when(c.contains("Today"), now)
        .when(c.contains("Yesterday"), F.date_sub(now, 1))
        .when(month.isNotNull(), safe_date(year, month, capture_int(c, r"(\d+)\s+(\w+)")))
    )


def clock_date(c: Column) -> Column:
    """'14:05, 3 March 2018' as timestamp without zone."""
    return F.try_to_timestamp(c, F.lit("H:mm, d MMMM yyyy")).cast("timestamp_ntz")


def weekday_date(c: Column) -> Column:
    """'Sunday, March 4, 2018 at 2:05PM' as timestamp without zone; the day name and a
    missing blank after 'at' are of no weight. 12-hour clock."""
    text = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]+,\s*", ""), r"\s+at\s*", " ")
    return F.try_to_timestamp(text, F.lit("MMMM d, yyyy h:mma")).cast("timestamp_ntz")


def long_date(c: Column) -> Column:
    """First 'd Month yyyy' in a text."""
    found = r"\b(\d+) ([A-Z][a-z]+) (\d+)\b"
    return let(c, lambda c: safe_date(
        F.regexp_extract(c, found, 3), month_number(F.regexp_extract(c, found, 2)), F.regexp_extract(c, found, 1)))


def mixed_date(c: Column, today: date) -> Column:
    """A resume card's date: year, 'Mon yyyy', 'Mon yyyy - Mon yyyy', 'Mon yyyy - Present'
    or free text, as struct<raw, year, day, start, end>."""
    month_year, span = r"^(\w+) (\d+)$", r"^(\w+) (\d+)\s+-\s+(\w+) (\d+)$"
    open_span = r"^(\w+) (\d+)\s+-\s+Present$"

    def first_day(c: Column, pattern: str, name: int, year: int) -> Column:
        return safe_date(F.regexp_extract(c, pattern, year),
                         month_number(F.regexp_extract(c, pattern, name)), F.lit(1))

    def parts(c: Column) -> Column:
        closed, is_open = c.rlike(span), c.rlike(open_span)
        return F.struct(
            c.alias("raw"),
            F.when(c.rlike(r"^\d+$"), c.try_cast("int")).alias("year"),
            F.when(c.rlike(month_year), first_day(c, month_year, 1, 2)).alias("day"),
            F.when(closed, first_day(c, span, 1, 2))
            .when(is_open, first_day(c, open_span, 1, 2)).alias("start"),
            F.when(closed, first_day(c, span, 3, 4)).when(is_open, F.lit(today)).alias("end"),
        )

    return let(strip(F.translate(c, "\u00a0", " ")), parts)


def last_active(c: Column, today: date) -> Column:
    """'Last Active: ...' with a full date, 'Yesterday', 'Today' or hours ago; any other
    phrase counts as a week ago, no phrase as unknown."""
    now = F.lit(today)

    def found(c: Column) -> Column:
        return F.coalesce(long_date(c), let(F.regexp_extract(c, r"Last Active:\s+(.*)$", 1), lambda phrase: (
            F.when(phrase.rlike("^Yesterday"), F.date_sub(now, 1))
            .when(phrase.rlike("^Today|[Hh]ours? [Aa]go"), now)
            .when(phrase != "", F.date_sub(now, 7)))))

    return let(F.translate(c, "\u00a0", " "), found)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def month_start(c: Column) -> Column:
    return F.trunc(F.to_date(c), "MM")


def months_since(c: Column, today: date) -> Column:
    """Calendar months back to a date; -1 where it is unknown."""
    months = (today.year - F.year(c)) * 12 + (today.month - F.month(c))
    return F.coalesce(months, F.lit(-1))


def age_years(birth: Column, today: date) -> Column:
    return F.floor(F.datediff(F.lit(today), birth) / 365).cast("int")


def birth_date(c: Column) -> Column:
    """Date of a text that starts with number-number-number, else null."""
    return F.when(c.rlike(r"^\d+-\d+-\d+"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def local_stamp(utc: Column, zone: str) -> tuple[Column, Column]:
    """Date and HH:mm in a site's zone of a UTC timestamp without zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.to_date(local), F.date_format(local, "HH:mm")

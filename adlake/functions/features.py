"""Feature columns of ads and resumes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions.text import capture_int, strip, whole_word


def member_flag(c: Column, values: Sequence[str]) -> Column:
    """1 where the value is in the list, else 0 (also for null)."""
    return F.coalesce(c.isin(list(values)), F.lit(False)).cast("int")


def equals_flag(c: Column, value: str) -> Column:
    """1 where the trimmed text equals the value, else 0 (also for null)."""
    return F.coalesce(strip(c) == value, F.lit(False)).cast("int")


def compensation(c: Column, credible_from: float = 100) -> dict[str, Column]:
    """Amount without thousands commas, whether there is one, whether it is credible, and
    the amount kept only where credible."""
    amount = F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    credible = F.coalesce(amount >= credible_from, F.lit(False))
    return {
        "has_comp": amount.isNotNull().cast("int"),
        "has_credible_comp": credible.cast("int"),
        "comp": F.when(credible, amount),
    }


def first_level(c: Column, ladder: Mapping[str, Sequence[str]]) -> Column:
    """First level of the ladder one of whose patterns is in the text as whole words."""
    return F.coalesce(*[F.when(c.rlike(whole_word("|".join(terms))), level)
                        for level, terms in ladder.items()])


def last_level(c: Column, ladder: Mapping[str, Sequence[str]]) -> Column:
    """Last level of the ladder one of whose patterns starts the text; null if none."""
    return F.coalesce(*[F.when(c.rlike("^" + whole_word("|".join(terms))), level)
                        for level, terms in reversed(ladder.items())])


def education_level(coded: Column, description: Column,
                    ladder: Mapping[str, Sequence[str]] = rules.EDUCATION_TERMS,
                    further: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The coded level where it is one of the ladder's, else the first level found in the
    description, else the first found with the ``further`` patterns."""
    text = F.lower(description)
    found = [F.when(coded.isin(list(ladder)), coded), first_level(text, ladder)]
    if further:
        found.append(first_level(text, further))
    return F.coalesce(*found)


def experience_range(c: Column) -> tuple[Column, Column]:
    """Least and most years: 'a to b years', 'More than a', 'Less than a', 'a years'."""
    span, more, less, exact = (r"^(\d+) to (\d+) years", r"^More than (\d+) years",
                               r"^Less than (\d+) years", r"^(\d+) years")
    low = (
        F.when(c.rlike(span), capture_int(c, span))
        .when(c.rlike(more), capture_int(c, more))
        .when(c.rlike(less), 0)
        .when(c.rlike(exact), capture_int(c, exact))
    )
    high = (
        F.when(c.rlike(span), capture_int(c, span, 2))
        .when(c.rlike(more), 30)
        .when(c.rlike(less), capture_int(c, less))
        .when(c.rlike(exact), capture_int(c, exact))
    )
    return low, high


def vacancies(c: Column) -> Column:
    """Leading number of 'n open positions', else 1."""
    return F.coalesce(capture_int(c, r"^(\d+) open position"), F.lit(1))


def requirement_lines(c: Column, separator: str = ">") -> Column:
    return F.size(F.split(c, separator))


def has_text(c: Column, text: str = "bachelor") -> Column:
    return c.contains(text).cast("int")


def full_address(c: Column, suffix: str = "Egypt") -> Column:
    return F.when(c.contains(suffix), c).otherwise(F.concat(c, F.lit(f", {suffix}")))


def province(c: Column, provinces: Sequence[str] = tuple(rules.PROVINCES)) -> Column:
    """First listed province named in the address, else 'Other'."""
    pattern = "(" + "|".join(provinces) + ")"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise("Other")

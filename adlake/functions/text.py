"""Text columns: cleaning, tokens, captures, list text."""

from __future__ import annotations

import html
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake import rules

# The one Python function below travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letter, digit or underscore of any script; Java's \w is ASCII only.
WORD = r"\p{L}\p{N}_"
BLANK = r"[\s\x{a0}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that names an outer expression evaluates it again for each element;
    binding it as the lambda's own argument avoids that.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without blanks (also no-break ones) at both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def whole_word(pattern: str) -> str:
    """The pattern as whole words of any script."""
    return f"(?<![{WORD}])(?:{pattern})(?![{WORD}])"


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """Captured text, null where the pattern is absent. For groups that are never empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def capture_int(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def slug(c: Column) -> Column:
    """URL form of a place name: lower case, separators as single '-'."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s()+?|'.]", "-"), "-+", "-")


def count_label(c: Column) -> tuple[Column, Column]:
    """'Name (1,234)' as name and count."""
    name = strip(F.regexp_extract(c, r"^([^(]*)", 1))
    digits = F.regexp_replace(F.regexp_extract(c, r"\(([\d,]+)\)", 1), ",", "")
    return name, digits.try_cast("int")


def clean_description(c: Column) -> Column:
    """Trimmed lines that hold a word, without HTML comments; no-break space is a newline."""
    lines = F.filter(F.split(c, r"[\n\t\r]"), lambda x: x.rlike(f"[{WORD}]"))
    joined = F.array_join(F.transform(lines, strip), "\n")
    return F.translate(F.regexp_replace(joined, r"<!--.*?-->", ""), "\u00a0", "\n")


def flatten_lines(c: Column) -> Column:
    """One line: carriage return to blank, newline to '>'."""
    return F.translate(c, "\r\n", " >")


def join_list(items: Column) -> Column:
    return F.array_join(items, ">")


def split_list(c: Column) -> Column:
    return F.split(c, ">")


def clean_item(c: Column) -> Column:
    """List item without brackets and quotes."""
    return F.regexp_replace(c, r"[\[\]']", "")


def keep_alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9a-zA-Z]+", "")


def strip_punct(c: Column) -> Column:
    """Requirement line: lower case, no full stops at the ends, no semicolons."""
    return F.replace(F.btrim(F.lower(c), F.lit(".")), F.lit(";"), F.lit(""))


def normalise_requirements(c: Column, separator: str = ">",
                           synonyms: Sequence[tuple[str, str]] = tuple(rules.REQUIREMENT_SYNONYMS),
                           ) -> Column:
    """Requirement text with digits and punctuation removed and synonyms unified,
    line by line, lines joined by a blank. Traces of printed bytes (b'..', \\x..) go too."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(strip(x), r"^b['\"]|\\x[0-9a-f]{2}|\\", "")
        x = F.regexp_replace(x, r"\d", "")
        x = F.regexp_replace(x, r"\s+", " ")
        x = F.translate(x, rules.REQUIREMENT_PUNCTUATION, "")
        for pattern, replacement in synonyms:
            x = F.regexp_replace(x, whole_word(pattern), replacement)
        return x

    return F.array_join(F.transform(F.split(c, separator), line), " ")


def clean_tokens(c: Column, stop: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS),
                 extra: Sequence[str] = tuple(rules.EXTRA_STOP_WORDS), min_length: int = 4) -> Column:
    """Blank-separated words, repeats kept, without stop words and short words."""
    dropped = sorted({w for w in (*stop, *extra) if len(w) >= min_length})
    return F.filter(F.split(c, r"\s+"),
                    lambda w: (F.length(w) >= min_length) & ~w.isin(dropped))


def words(c: Column) -> Column:
    """Lower-case words: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens as 'a b'."""

    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    return let(tokens, pairs)


def term_counts(terms: Column) -> Column:
    """array<struct<term, n>> of the distinct terms of one text, by term.

    Sorting the array brings equal terms together; each run's length is the distance
    between two run starts. The text's own row holds all that is needed, so counting
    terms per text takes no shuffle.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        positions = F.filter(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)),
        )
        return let(positions, lambda p: F.transform(
            p,
            lambda start, j: F.struct(
                F.get(s, start - 1).alias("term"),
                (F.coalesce(F.get(p, j + 1), n + 1) - start).cast("long").alias("n"),
            ),
        ))

    return let(F.sort_array(terms), runs)


def most_common(terms: Column, limit: int = 30) -> Column:
    """The ``limit`` most frequent terms as array<struct<term, n>>, ties by term."""
    ranked = F.sort_array(F.transform(
        term_counts(terms), lambda x: F.struct((-x["n"]).alias("k"), x["term"].alias("term"))))
    return F.transform(F.slice(ranked, 1, limit),
                       lambda x: F.struct(x["term"].alias("term"), (-x["k"]).alias("n")))


def label_class(c: Column, own_name: str | None = None) -> tuple[Column, Column]:
    """Class of a category link's label, and the label without the class words.

    ``own_name`` is the site's own name, which also marks a publisher.
    """
    publisher = rf"^[{WORD}]+ Website Jobs" + (f"|^{own_name}" if own_name else "")
    kind = (
        F.when(c.rlike(publisher), "publisher")
        .when(c.rlike(rf"^[{WORD}]+ Jobs"), "occupation")
        .when(c.rlike(rf"^Jobs in [{WORD}]+"), "location")
    )
    return kind, F.regexp_replace(c, "Jobs in |( Website)* Jobs", "")


@F.arrow_udf(T.StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    # Few texts of a batch are Python strings at once.
    parts = [pa.array([None if x is None else html.unescape(x) for x in texts.slice(at, 100).to_pylist()], pa.string())
             for at in range(0, len(texts), 100)]
    return pa.concat_arrays(parts or [pa.array([], pa.string())])


def html_unescape(c: Column) -> Column:
    """Entities to characters. Texts without '&' are not sent to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def money_digits(c: Column, all_digits: bool = False) -> Column:
    """Whole amount in a price text; of a range the first number.

    ``all_digits`` runs the digits of all numbers together, as older data has it.
    """
    text = c if all_digits else F.regexp_extract(c, r"(\d[\d,]*)", 1)
    return F.regexp_replace(text, "[^0-9]", "").try_cast("long")


def salary_text(c: Column) -> Column:
    return F.when(c.contains("Negotiable"), c).otherwise(F.replace(c, F.lit(","), F.lit("")))


def starts_arabic(c: Column) -> Column:
    return c.rlike(r"^[\x{0627}-\x{064a}]")


def location_split(c: Column) -> tuple[Column, Column]:
    """'Country - Region' as its two parts; no region gives null."""
    parts = F.split(c, "-")
    return strip(F.get(parts, 0)), strip(F.get(parts, 1))


def decode_utf8(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def title_label(c: Column) -> Column:
    return F.initcap(c)


def sentinel_null(c: Column, sentinel: str = "-") -> Column:
    return F.nullif(c, F.lit(sentinel))

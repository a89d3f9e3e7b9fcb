"""Nested resume documents: building, flattening, translation items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions.text import starts_arabic
from adlake.operators.combine import distinct_keys, lookup_side



def nest_sections(items: DataFrame, uid: str, section: str, position: str,
                  fields: Sequence[str]) -> DataFrame:
    """Documents as rows (uid, section, items) with the items in order, one row per section
    at any length. A position occurs once in a section."""
    item = F.struct(position, *fields)
    return items.groupBy(uid, section).agg(F.sort_array(F.collect_list(item)).alias("items"))


def section_summary(nested: DataFrame, uid: str, section: str, field: str) -> DataFrame:
    """Number of items and first item of every section."""
    return nested.select(uid, section, F.size("items").cast("long").alias("items"),
                         F.get("items", F.lit(0))[field].alias(f"first_{field}"))


def rename_fields(items: Column, names: Mapping[str, str], present: Sequence[str]) -> Column:
    """Section array with the generic card fields renamed for the section."""
    return F.transform(items, lambda x: F.struct(
        *[x[field].alias(names[field]) for field in present if field in names]))


def resume_sections(cards: DataFrame, uid: str,
                    mapping: Mapping[str, Mapping[str, str]] = rules.SECTION_FIELDS) -> DataFrame:
    """Cards (uid, section, listnum, date, subject, item1, item2, description) as nested
    sections, one column per section with its own field names."""
    generic = ["date", "subject", "item1", "item2", "description"]
    nested = nest_sections(cards, uid, "section", "listnum", generic)
    columns = [F.max(F.when(F.col("section") == s, rename_fields(F.col("items"), names, generic))).alias(s)
               for s, names in mapping.items()]
    return nested.groupBy(uid).agg(*columns)


def unnest_long(df: DataFrame, keys: Sequence[str], sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows (keys, column1, column2, listnum, text), one per text found.

    ``sections`` maps a column to its fields; '' stands for a plain string, alone or in an
    array. One pass: each field becomes an array of entries, and their concatenation is
    exploded.
    """
    entry = "array<struct<column1:string,column2:string,listnum:int,text:string>>"

    def entries(section: str, field: str) -> Column:
        kind = df.schema[section].dataType.typeName()
        column = F.col(section) if kind == "array" else F.array(F.col(section))

        def make(x: Column, i: Column) -> Column:
            value = x[field] if field else x
            return F.struct(F.lit(section).alias("column1"), F.lit(field or section).alias("column2"),
                            i.alias("listnum"), value.cast("string").alias("text"))

        return F.coalesce(F.transform(column, make), F.array().cast(entry)).cast(entry)

    parts = [entries(s, f) for s, fields in sections.items() for f in fields]
    return (df.select(*keys, F.explode(F.concat(*parts)).alias("_e")).select(*keys, "_e.*")
            .filter(F.col("text").isNotNull()))


def unnest_parts(nested: DataFrame, uid: str, section: str, position: str,
                 fields: Sequence[str]) -> DataFrame:
    """The rows ``nest_sections`` was made of, one per field: (uid, section, field, position, text)."""
    rows = nested.select(uid, section, F.explode("items").alias("_i"))
    wide = rows.select(uid, section, F.col(f"_i.{position}").alias(position),
                       *[F.col(f"_i.{f}").alias(f) for f in fields])
    return (wide.unpivot([uid, section, position], list(fields), "field", "text")
            .filter(F.col("text").isNotNull()))


def kv_columns(entries: Column, names: Mapping[str, str]) -> dict[str, Column]:
    """Key/value cells (array<struct<key,value>>) as named columns; of a repeated key the
    last cell counts, an absent key is null."""
    def value(key: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]

    return {name: value(key) for key, name in names.items()}


def last_values(df: DataFrame, by: str, key: str, value: str, order: Sequence[str],
                keys: Sequence[str]) -> DataFrame:
    """Key/value rows as one row per group with the last value of each key; one aggregate,
    no array of cells is built."""
    def last(k: str) -> Column:
        return F.max_by(value, F.when(F.col(key) == k, F.struct(*order))).alias(k)

    return df.groupBy(by).agg(*[last(k) for k in keys])


def translate_items(items: DataFrame, text: str, glossary: DataFrame, source: str = "source",
                    target: str = "target", needs: Column | None = None) -> DataFrame:
    """Adds ``needs`` (by default: the text starts with an Arabic letter) and ``translated``:
    the glossary's entry, null while there is none, or the text itself if it needs none.

    The items are made and read once: a text that needs none meets no entry, in the same join. Where
    the glossary is too large to broadcast, AQE can split a hot text.
    """
    needs = starts_arabic(F.col(text)) if needs is None else needs
    flagged = items.withColumn("needs", F.coalesce(needs, F.lit(False)))
    terms = lookup_side(glossary.select(F.col(source).alias("_source"), F.col(target).alias("_target")), ["_source"])
    found = flagged.join(terms, (F.col(text) == F.col("_source")) & F.col("needs"), "left")
    return found.select(*flagged.columns, F.when(F.col("needs"), F.col("_target")).otherwise(F.col(text)).alias("translated"))


def nothing_to_translate(ids: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids none of whose texts is an item to translate."""
    return ids.select(*keys).join(distinct_keys(items, keys), list(keys), "left_anti")

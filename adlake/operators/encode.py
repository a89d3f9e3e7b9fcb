"""Categories to indicator columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions import text
from adlake.operators import stats
from adlake.operators.combine import map_literal


def collapse_rare(df: DataFrame, columns: Sequence[str], min_share: float = 0.05,
                  other: str = "other") -> DataFrame:
    """Values that make up less than ``min_share`` of all rows become 'other'; null stays null.

    The values kept are those of ``stats.frequent_values``: at most 1 / min_share a column, so they
    are one small row, read as a scalar.
    """
    common = stats.frequent_values(df, columns, min_share)
    lists = common.agg(*[F.collect_set(F.when(F.col("variable") == c, F.col("value"))).alias(f"_common_{i}")
                         for i, c in enumerate(columns)])
    found = lists.select(F.struct(*lists.columns)).scalar()
    return df.withColumns({
        c: F.when(F.array_contains(found[f"_common_{i}"], F.col(c).cast("string")), F.col(c))
        .when(F.col(c).isNotNull(), F.lit(other)) for i, c in enumerate(columns)})


def indicator_values(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The ``most`` commonest values, in order of name, for column names. What other values
    there are shows in the rest column of ``one_hot`` and ``multi_hot``."""
    rows = (df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL")
            .groupBy("v").count().orderBy(F.desc("count"), "v").limit(most).collect())
    return sorted(r["v"] for r in rows)


def column_name(*parts: str) -> str:
    return "_".join(parts)


def one_hot(df: DataFrame, columns: Mapping[str, Sequence[str]],
            rest: str | None = None) -> tuple[DataFrame, list[str]]:
    """0/1 column ``column_value`` per value, null giving 0 in all; with the new names.

    With ``rest`` one more column of that name says that a value is none of those listed.
    """
    new = {column_name(c, v): F.coalesce(F.col(c) == v, F.lit(False)).cast("int")
           for c, values in columns.items() for v in values}
    if rest is not None:
        new |= {column_name(c, rest): (F.col(c).isNotNull() & ~F.coalesce(
            F.col(c).isin(list(values)), F.lit(False))).cast("int") for c, values in columns.items()}
    return df.withColumns(new), list(new)


def multi_hot(df: DataFrame, columns: Sequence[str], values: Sequence[str],
              prefix: str, rest: str | None = None) -> DataFrame:
    """0/1 column per value that says whether any of the columns holds it. Take the values
    from the first column (``indicator_values``). With ``rest`` one more column of that name
    says whether any column holds a value that is not listed."""
    present = F.array(*[F.col(c) for c in columns])
    new = {column_name(prefix, v): F.coalesce(F.array_contains(present, v), F.lit(False)).cast("int") for v in values}
    if rest is not None:
        listed = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        new[column_name(prefix, rest)] = (F.size(F.array_except(F.array_compact(present), listed)) > 0).cast("int")
    return df.withColumns(new)


def first_items(df: DataFrame, column: str, prefix: str, n: int = 3,
                mapping: Mapping[str, str] | None = None) -> DataFrame:
    """The first n items of a '>' list as columns prefix0, prefix1, ..., each replaced by
    its entry in the mapping if it has one."""

    def item(i: int) -> Column:
        value = text.clean_item(F.get(text.split_list(F.col(column)), i))
        return map_literal(value, mapping) if mapping else value

    return df.withColumns({f"{prefix}{i}": item(i) for i in range(n)})


def skill_tags(df: DataFrame, tokens: str,
               words: Mapping[str, Sequence[str]] = rules.SKILL_WORDS,
               pairs: Mapping[str, Sequence[str]] = rules.SKILL_BIGRAMS,
               most: int = 30) -> DataFrame:
    """Adds ``<kind>_skills``: the tag words of the kind among the commonest tokens of a text
    plus its tag bigrams among the commonest bigrams."""
    terms = df.withColumns({
        "_words": F.transform(text.most_common(F.col(tokens), most), lambda x: x["term"]),
        "_pairs": F.transform(text.most_common(text.bigrams(F.col(tokens)), most), lambda x: x["term"]),
    })

    def hits(column: str, tags: Sequence[str]) -> Column:
        return F.size(F.array_intersect(column, F.array(*[F.lit(t) for t in tags])))

    return terms.withColumns({
        f"{kind}_skills": hits("_words", words[kind]) + hits("_pairs", pairs[kind]) for kind in words
    }).drop("_words", "_pairs")

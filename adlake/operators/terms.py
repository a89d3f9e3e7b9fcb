"""Word and bigram counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake import rules
from adlake.functions import text


def top_terms(df: DataFrame, key: str, tokens: Column, limit: int = 30,
              allowed: Sequence[str] | None = None) -> DataFrame:
    """The commonest tokens of each text as rows (key, place, term, n).

    Counted inside the text's own row; nothing is shuffled. ``allowed`` is an optional
    list of terms, such as nouns, that the commonest ones are then kept to.
    """
    ranked = df.select(key, F.posexplode(text.most_common(tokens, limit)).alias("place", "_t"))
    rows = ranked.select(key, (F.col("place") + 1).alias("place"), "_t.term", "_t.n")
    return rows if allowed is None else rows.filter(F.col("term").isin(list(allowed)))


def top_bigrams(df: DataFrame, key: str, tokens: Column, limit: int = 30,
                nouns: Sequence[str] | None = None) -> DataFrame:
    """The commonest bigrams of each text. With ``nouns`` those stay that hold a noun and
    are not one word twice."""
    rows = top_terms(df, key, text.bigrams(tokens), limit)
    if nouns is None:
        return rows
    words = F.split("term", " ")
    first, second = F.get(words, 0), F.get(words, 1)
    return rows.filter((first.isin(list(nouns)) | second.isin(list(nouns))) & (first != second))


def keyword_totals(df: DataFrame, keys: Sequence[str], description: str,
                   keywords: Sequence[str] = tuple(rules.KEY_WORDS)) -> DataFrame:
    """Occurrences of each keyword over the distinct (keys, description).

    A text is cut down to its keyword hits before the shuffle, and a digest stands for it
    when telling equal texts apart, so texts themselves are not moved.
    """
    hits = F.filter(text.words(F.col(description)), lambda w: w.isin(list(keywords)))
    # No filter on the hits here: it would be pushed down and find them a second time.
    distinct = (df.select(*keys, F.sha2(F.col(description), 256).alias("_digest"), hits.alias("_hits"))
                .dropDuplicates([*keys, "_digest"]))
    return (distinct.select(F.explode("_hits").alias("keyword"))
            .groupBy("keyword").agg(F.count(F.lit(1)).alias("n")))

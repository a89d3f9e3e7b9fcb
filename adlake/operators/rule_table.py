"""Rules as a table: phrases with a value and a rank, found in texts by a join.

A text is cut once into words and what lies between them; its phrases of up to so many words are then
exact pieces of the text with whole words at both ends, as the patterns of ``functions.text.whole_word``
would find them. One pass and one join serve any number of rules, where a chain of patterns scans the
text once per rule. Before the join, phrases go whose first word has not the hash of a rule's first word.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.functions.text import let
from adlake.operators.combine import lookup_side

BUCKETS = 4096
RULES = "phrase string, value string, rank int"
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def phrases(pattern: str) -> list[str]:
    """All texts that a pattern of optional letters, small classes and alternatives stands for.

    ``(x){0,1}``, ``[ab]``, ``(a|b)`` and escaped dots are known; a pattern is a list of alternatives itself.
    """
    rest = [f"({pattern})".replace("){0,1}", "|)").replace("\\.", "\0")]
    out = []
    while rest:
        text = rest.pop()
        if "[" in text:
            head, _, tail = text.partition("[")
            letters, _, tail = tail.partition("]")
            rest.append(f"{head}({'|'.join(letters)}){tail}")
        elif "(" in text:
            end = text.index(")")
            start = text.rindex("(", 0, end)
            rest += [text[:start] + one + text[end + 1:] for one in text[start + 1:end].split("|")]
        else:
            out.append(text.replace("\0", "."))
    return sorted(set(out))


def rules_of(spark: SparkSession, ladder: Mapping[str, Sequence[str]]) -> DataFrame:
    """The rule table of a ladder of patterns; rank is the place of the level."""
    rows = [(p, level, rank) for rank, (level, patterns) in enumerate(ladder.items())
            for pattern in patterns for p in phrases(pattern)]
    return spark.createDataFrame(rows, RULES)


def _trimmed(phrase: Column) -> Column:
    """Punctuation at the ends stands beside whole words anyway."""
    return F.regexp_replace(F.lower(phrase), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def text_phrases(text: Column, longest: int, at_start: bool = False, firsts: Sequence[int] | None = None) -> Column:
    """The distinct phrases of 1 to ``longest`` words of a text; with ``at_start`` only those that begin it,
    with ``firsts`` only those whose first word falls in one of these buckets."""
    word = F.lower(text).rlike(r"^[\p{L}\p{N}_]")
    pieces = let(F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0)), lambda p: F.when(word, p).otherwise(
        F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))))
    bits = [0] * (BUCKETS // 32)
    for bucket in firsts or ():
        bits[bucket // 32] |= 1 << bucket % 32
    known = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")

    def first_known(starts: Column, p: Column) -> Column:
        if firsts is None:
            return starts
        return let(known, lambda k: F.filter(starts, lambda i: let(_bucket(F.get(p, 2 * i)), lambda b: (
            F.getbit(F.get(k, F.shiftright(b, 5)), b.bitwiseAND(31)) == 1))))

    def all_of(p: Column) -> Column:
        words = F.floor((F.size(p) + 1) / 2).cast("int")
        starts = F.when(words > 0, F.sequence(F.lit(0), F.lit(0) if at_start else words - 1)).otherwise(
            F.array().cast("array<int>"))
        return let(first_known(starts, p), lambda known_starts: F.concat(*[
            F.transform(F.filter(known_starts, lambda i: i + n <= words), lambda i: F.array_join(F.slice(p, 2 * i + 1, 2 * n - 1), ""))
            for n in range(1, longest + 1)]))

    pieces = F.when(word | F.lit(not at_start), pieces).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(let(pieces, all_of))


def _hits(df: DataFrame, keys: Sequence[str], text: str, rules: DataFrame, at_start: bool) -> DataFrame:
    known = lookup_side(rules.select(_trimmed(F.col("phrase")).alias("_phrase"), "value", "rank").filter("_phrase <> ''"), ["_phrase"])
    words = F.regexp_extract_all(_trimmed(F.col("phrase")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # Of the rules only the buckets of their first words come here, however many rules there are.
    longest, firsts = rules.agg(F.max(F.size(words)), F.collect_set(_bucket(F.get(words, 0)))).first()
    grams = df.select(*keys, F.explode_outer(text_phrases(F.col(text), longest or 1, at_start, firsts)).alias("_gram"))
    return grams.join(known, F.col("_gram") == F.col("_phrase"), "left")


def level_by_rules(df: DataFrame, keys: Sequence[str], text: str, rules: DataFrame, last: bool = False,
                   at_start: bool = False) -> DataFrame:
    """``keys`` (one row each) and the ``value`` of the first rule by rank, or the ``last``, that the text holds; null if none.

    ``rules`` has phrase, value and rank. A text's hits are reduced to one row in its task, before anything is
    shuffled. A null text holds none.
    """
    pick = F.max_by if last else F.min_by
    found = _hits(df, keys, text, rules, at_start)
    return found.groupBy(*keys).agg(pick("value", F.when(F.col("value").isNotNull(), F.col("rank"))).alias("value"))


def texts_by_rule(df: DataFrame, keys: Sequence[str], text: str, rules: DataFrame) -> DataFrame:
    """Per value the number of texts that hold one of its phrases."""
    found = _hits(df, keys, text, rules, False).filter(F.col("value").isNotNull())
    return found.select(*keys, "value").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n"))

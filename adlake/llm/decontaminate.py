"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes a template: numbers, names and units give way to typed placeholders, the rest is
lower-cased and stripped of punctuation. There are three variants, as the case of a word does not settle
whether it is a name: capitals play no part and names are plain words; names are capitalised words after
another word; names are all capitalised words. A window is matched if any variant matches. Windows of five template words are joined by hash. A document can only hold 0.8 of an item's windows if it holds one of the item's rarest fifth (and
one more), so only those are looked for in all documents; the documents found are then compared
in full. Where a window of the document lies on a window of the item, slot values are set
against each other: an item's value must always become the same value and two values must not
become one, else the windows that hold a changed value of that kind do not count. So an item with other numbers or names in it is still found, but not a text that
merely shares its frame with changing fillings.

A name may become one of more or fewer words (Lyon, San Jose), a number too (200, two hundred). So each item
is a second time a class of its own, in which runs of names and of numbers with nothing but white space
between them are one word; windows are counted in these words there. It is asked only where the document or the item
has a run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import stored

WINDOW = 5
CONTAINMENT = 0.8
NAME, NUMBER, UNIT = "", "", ""
#: Units of measure, time and currency that may follow a number, in any case.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "s",
         "sec", "min", "h", "hr", "hrs", "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?", "years?",
         "(?:kilo|centi|milli)?met(?:er|re)s?", "miles?", "yards?", "foot", "feet", "inch(?:es)?",
         "(?:kilo|milli)?grams?", "pounds?", "ounces?", "tons?", "tonnes?", "(?:milli)?lit(?:er|re)s?", "dollars?",
         "euros?", "cents?", "percent", "degrees?", "kmh", "mph"]
#: English number words, also joined by hyphens.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
                "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty",
                "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen"]
#: Capitals that begin a name: two letters at least, or an apostrophe and a capital after the first (O'Brien).
_CAPITAL = r"\p{Lu}(?=[\p{L}\p{M}]|['\u2019]\p{Lu})"
_NAME = rf"(?<=[\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{UNIT},;]\s){_CAPITAL}"
_ANY = "|".join(NUMBER_WORDS)
_NUMBER = (r"\d+(?:[.,:]\d+)*|(?<![\p{L}\p{M}\p{N}])(?=[a-zA-Z]{3})"
           rf"(?i:(?:{_ANY})(?:-(?:{_ANY})){{0,3}})(?![\p{{L}}\p{{M}}\p{{N}}])")
_UNIT = rf"(?<={NUMBER}[\s-]?)(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])"
#: Before its first letter: a word that is a name by its case and the word before it, or by its case alone.
_NAMED, _CAPITALISED = "\ue003", "\ue004"
_FIRST = rf"(?<![\p{{L}}\p{{M}}\p{{N}}{NAME}-{_CAPITALISED}]){_CAPITAL}"
#: So many words of a window must be plain where names are told by their case alone.
PLAIN = 2
#: In place of the white space inside a run of names or numbers.
_RUN = "\ue005"
_JOINED = (rf"([{_NAMED}{_CAPITALISED}][\p{{L}}\p{{M}}'\u2019{_NAMED}{_CAPITALISED}-]+)\s(?={_NAMED})"
           rf"|({NUMBER})\s(?={NUMBER}(?![\p{{L}}\p{{M}}]))")
_WORD = rf"\p{{L}}\p{{M}}{NAME}-{_RUN}"
_EDGE = rf"(?<=[{_WORD}])[^{_WORD}\s]+|[^{_WORD}\s]+(?=[{_WORD}])"
_SLOT = f"[{NAME}-{UNIT}]"
#: At most so many windows to look for are sent to every task (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: So many plain words in a row, and at most so many rows, are asked for before a text is made a template; of more all texts are.
ROW, RUNS = 3, 20_000


def marked(text: Column) -> Column:
    """A text in lower case, without punctuation at words, with typed placeholders, a mark before each name, and
    a mark for white space inside a run of names or numbers."""
    out = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), _NUMBER, NUMBER)
    out = F.regexp_replace(out, _UNIT, UNIT)
    out = F.regexp_replace(out, _NAME, f"{_NAMED}$0")
    out = F.regexp_replace(out, _FIRST, f"{_CAPITALISED}$0")
    out = F.regexp_replace(out, _JOINED, f"$1$2{_RUN}")
    return F.regexp_replace(F.lower(out), _EDGE, "")


def templates(text: Column) -> list[Column]:
    """Template words of a marked text, one for each of its words parted by white space, in each variant.

    In the first capitals play no part: names stand as they are. In the next, names after a word, comma or
    semicolon are placeholders, in the last all capitalised words, also those that begin a sentence.
    """
    return [F.split(out, r"\s+") for out in (
        F.translate(text, _RUN + _NAMED + _CAPITALISED, " "),
        F.regexp_replace(F.translate(text, _RUN + _CAPITALISED, " "), rf"{_NAMED}\S*", NAME),
        F.regexp_replace(F.translate(text, _RUN, " "), rf"[{_NAMED}{_CAPITALISED}]\S*", NAME))]


def folded(text: Column) -> Column:
    """Template words of a marked text with all capitalised words as names and each run as one word."""
    names = F.regexp_replace(text, rf"[{_NAMED}{_CAPITALISED}]\S*", NAME)
    return F.split(F.regexp_replace(names, rf"(?:{NUMBER}{_RUN})+(?={NUMBER})", ""), r"\s+")


def starts(words: Column, before: Column | None = None) -> Column:
    """Where windows of template words begin: all, or those that hold a word which the variant before has otherwise."""
    last = F.size(words) - WINDOW
    if before is None:
        return F.when(last >= 0, F.sequence(F.lit(0), last))
    return _around(words, lambda i: F.get(words, i) != F.get(before, i))


def _around(words: Column, wanted: Callable[[Column], Column]) -> Column:
    """Where windows begin that hold a wanted place."""
    last = F.size(words) - WINDOW
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), wanted)
    near = F.transform(places, lambda i: F.sequence(F.greatest(i - WINDOW + 1, F.lit(0)), F.least(i, last)))
    return F.when(last >= 0, F.array_distinct(F.flatten(near)))


def _hash(words: Column | str, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])


def _value(raw: Column) -> Column:
    """What fills a slot: the raw word without case and without punctuation at its ends."""
    return F.regexp_replace(F.lower(raw), r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")


def _pair(s: Column) -> Column:
    """A pair of fillings without the first word if runs begin with the same: it may only open a sentence (If Anna)."""
    same = F.substring_index(s["of"], " ", 1) == F.substring_index(s["to"], " ", 1)
    both = same & s["of"].contains(" ") & s["to"].contains(" ")

    def rest(c: Column) -> Column:
        return F.when(both, F.substr(c, F.instr(c, " ") + 1)).otherwise(c)

    return F.struct(rest(s["of"]).alias("of"), rest(s["to"]).alias("to"))


def _variants(rows: DataFrame, keep: list[str], extra: dict[str, Column] | None = None) -> tuple[DataFrame, list[tuple[str, str | None]]]:
    """``keep``, ``extra`` (made of the marked text) and the words of each variant; the names of these columns, each with that of the variant before."""
    # marks and words are columns of their own: inside a lambda they would be made anew for each window
    kinds = templates(F.col("__marked"))
    names = [f"__words{i}" for i in range(len(kinds))]
    words = rows.withColumn("__marked", marked(F.col("text"))).select(
        *keep, *[c.alias(n) for n, c in (extra or {}).items()], *[c.alias(n) for c, n in zip(kinds, names)])
    return words, list(zip(names, [None, *names]))


def hashes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs, hash) of all windows of the column ``text`` in every variant and, where it has runs, of the
    windows that hold one as one word."""
    marks = F.col("__marked")
    runs = F.contains(marks, F.lit(_RUN))
    words, variants = _variants(rows, keys, {"__parts": F.when(runs, F.split(marks, r"\s+")), "__folded": F.when(runs, folded(marks))})

    def hashed(w: str, before: str | None) -> Column:
        return F.transform(starts(F.col(w), None if before is None else F.col(before)), lambda i: _hash(w, i))

    around = _around(F.col("__folded"), lambda i: F.contains(F.get("__parts", i), F.lit(_RUN)))
    of_runs = F.coalesce(F.transform(around, lambda i: _hash("__folded", i)), F.array().cast("array<bigint>"))
    each = [hashed(w, b) for w, b in variants]
    return words.select(*keys, F.col("__parts").isNotNull().alias("runs"), F.explode(F.concat(*each, of_runs)).alias("hash"))


def windows(rows: DataFrame, keys: list[str], place: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(keys, place, hash, slots) of the column ``text``; slots are the raw words under placeholders, by offset. The template
    words come with them if ``extra`` names ``words``.

    A place has a row in the first variant, and one in each other variant whose words differ there. In the last
    variant windows with fewer than ``PLAIN`` plain words are left out: capitals alone would fit each other.
    """
    words, variants = _variants(rows.withColumn("__raw", F.split("text", r"\s+")), [*keys, "__raw"])

    def made(w: str, before: str | None) -> Column:
        def window(i: Column) -> Column:
            slots = [F.when(F.get(w, i + k).rlike(_SLOT), F.get("__raw", i + k)) for k in range(WINDOW)]
            words = [F.slice(w, i + 1, WINDOW).alias(n) for n in extra]
            return F.struct(i.alias("place"), _hash(w, i).alias("hash"), F.array(*slots).alias("slots"), *words)

        out = F.transform(starts(F.col(w), None if before is None else F.col(before)), window)
        enough = F.filter(out, lambda x: F.size(F.filter(x["slots"], lambda s: s.isNull())) >= PLAIN)
        return enough if w == variants[-1][0] else out

    # windows are put together inside the row: exploded first, each would carry all words of its text
    each = words.select(*keys, F.explode(F.concat(*[made(w, b) for w, b in variants])).alias("w"))
    return each.select(*keys, F.col("w.place").alias(place), "w.hash", "w.slots", *[f"w.{n}" for n in extra])


def folded_windows(rows: DataFrame, keys: list[str], place: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """As ``windows``, with each run as one word, and with (n, runs): the windows of the text, and whether it has runs."""
    marks = F.col("__marked")
    words = (rows.withColumn("__marked", marked(F.col("text")))
             .select(*keys, F.split("text", r"\s+").alias("__raw"), F.split(marks, r"\s+").alias("__parts"),
                     folded(marks).alias("__folded"), F.contains(marks, F.lit(_RUN)).alias("runs")))
    # of each raw word the folded word it is in, then of each folded word its first raw word
    inside = F.flatten(F.transform("__parts", lambda p, k: F.array_repeat(k, F.size(F.split(p, _RUN)))))
    words = words.withColumn("__in", inside)
    first = F.filter(F.sequence(F.lit(0), F.size("__in") - 1), lambda i: (i == 0) | (F.get("__in", i) != F.get("__in", i - 1)))
    words = words.withColumns({"__at": first, "n": F.size("__folded") - (WINDOW - 1)})

    def slot(i: Column) -> Column:
        at = F.get("__at", i)
        raw = F.slice("__raw", at + 1, F.coalesce(F.get("__at", i + 1), F.size("__raw")) - at)
        return F.when(F.get("__folded", i).rlike(_SLOT), F.array_join(raw, " "))

    made = F.transform(starts(F.col("__folded")), lambda i: F.struct(
        i.alias("place"), _hash("__folded", i).alias("hash"), F.array(*[slot(i + k) for k in range(WINDOW)]).alias("slots"),
        *[F.slice("__folded", i + 1, WINDOW).alias(n) for n in extra]))
    enough = F.filter(made, lambda x: F.size(F.filter(x["slots"], lambda s: s.isNull())) >= PLAIN)
    each = words.select(*keys, "n", "runs", F.explode(enough).alias("w"))
    return each.select(*keys, F.col("w.place").alias(place), "w.hash", "w.slots", *[f"w.{n}" for n in extra], "n", "runs")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(class, item_id, n_windows, at, hash, slots, words, folded, runs) of each different item text.

    Items of equal text are one class, named by the least item_id, and one more with runs folded.
    """
    items = (benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
             .withColumn("class", F.xxhash64("text")))
    parts = windows(items, ["class", "item_id"], "at", ("words",))
    whole = parts.withColumns({"n_windows": F.max("at").over(Window.partitionBy("class")) + 1,
                               "folded": F.lit(False), "runs": F.lit(False)})
    second = items.withColumn("class", F.xxhash64(F.lit("folded"), "text"))
    short = folded_windows(second, ["class", "item_id"], "at", ("words",)).withColumnRenamed("n", "n_windows").withColumn("folded", F.lit(True))
    return whole.unionByName(short)


def seeds(items: DataFrame) -> DataFrame:
    """(hash, class, folded, item_runs, run): of each item some places, one more than it may lack, in all variants.

    Any places would do. Taken are those that have plain words in a row in each variant, as these are what few texts have,
    and of them the rarest. ``run`` is the hash of ``_run``.
    """
    spread = items.groupBy("hash").agg(F.count_distinct("class").alias("spread"))
    each = items.select("class", "at", "hash", "n_windows", "folded", F.col("runs").alias("item_runs"), _run("words")).join(spread, "hash")
    rarest = Window.partitionBy("class").orderBy(F.desc("row"), "spread", "at")
    places = (each.groupBy("class", "at", "n_windows").agg(F.sum("spread").alias("spread"), F.min("run.row").alias("row"))
              .withColumn("place", F.row_number().over(rarest)))
    may_lack = F.col("n_windows") - F.ceil(F.col("n_windows") * CONTAINMENT)
    places = places.filter(F.col("place") <= may_lack + 1).select("class", "at")
    return each.join(places, ["class", "at"]).select("hash", "class", "folded", "item_runs", "run").distinct()


def _letters(text: Column) -> Column:
    """A text in lower case with nothing but letters and white space. A template word without a placeholder that has a letter
    is what this makes of the raw word; a final sigma depends on what follows, so it is written as any other."""
    return F.translate(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\s]+", ""), "ς", "σ")


def _run(words: str) -> Column:
    """(row, hash) of a window: how many plain words stand in a row, ``ROW`` at most, and the hash of those of most letters.
    Without a plain word that has a letter it is (0, null)."""
    letters = F.transform(F.col(words), lambda w: F.when(~w.rlike(_SLOT) & (_letters(w) != ""), _letters(w)))

    def rows(n: int) -> list[Column]:
        parts = [[F.get(letters, F.lit(i + k)) for k in range(n)] for i in range(WINDOW - n + 1)]
        # of a missing word the whole is null
        return [F.struct(F.lit(n).alias("row"), F.length(F.concat(*p)).alias("size"), _row_hash([F.xxhash64(w) for w in p]).alias("hash"))
                for p in parts]

    found = F.filter(F.array(*[r for n in range(1, ROW + 1) for r in rows(n)]), lambda r: r["size"].isNotNull())
    best = F.array_max(found)
    return F.struct(F.coalesce(best["row"], F.lit(0)).alias("row"), best["hash"].alias("hash")).alias("run")


def _row_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _may_hold(text: Column, runs: dict[int, list[int]]) -> Column:
    """Whether a text has one of the ``runs`` (hashes by number of words): if not, it has none of their windows in any variant.

    Raw words stay in their order, and only those without letters go, so plain words of a window that follow each
    other do so here. Where a text itself has the mark for white space its words are others, and it is let through.
    """
    def has(words: Column, n: int, hashes: list[int]) -> Column:
        rows = F.transform(words, lambda w, i: _row_hash([w, *[F.get(words, i + k) for k in range(1, n)]]))
        return F.exists(rows, lambda h: h.isin(hashes))

    def known(words: Column) -> Column:
        return reduce(Column.__or__, [has(words, n, runs[n]) for n in sorted(runs, reverse=True)], F.lit(False))

    # the words are an element of an array, so that they are made once wherever the filter is put
    words = F.transform(F.split(_letters(text), r"\s+"), lambda w: F.xxhash64(w))
    return F.contains(text, F.lit(_RUN)) | F.get(F.transform(F.array(words), known), F.lit(0))


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose text may hold a wanted window; all of them if there are over ``RUNS`` runs or a window has none."""
    runs: dict[int, list[int]] = {}
    found = wanted.select("run.row", "run.hash").distinct().limit(RUNS + 1).collect()
    for row, h in found:
        runs.setdefault(row, []).append(h)
    return rows if len(found) > RUNS or 0 in runs else rows.filter(_may_hold(F.col("text"), runs))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, n_windows, n_matched, reparameterised): documents that hold an item.

    ``key`` is the text's 64-bit hash. Null texts, and texts or items of fewer than five words,
    hold and are nothing. Items that repeat a text count once, under the least id. Rows that are
    equal in id and text give one row. Matched windows of an item need not lie in a row, but each
    alignment (place in the document less place in the item) must fill its changed slots consistently.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("key"), "text").filter(F.col("text").isNotNull())
    items = stored(item_windows(benchmark), "items")
    wanted = stored(seeds(items), "seeds")
    few = wanted.count() <= BROADCAST_ROWS
    # most texts hold no run of words of a wanted window: they are not made templates
    found = hashes(likely(rows, wanted), ["doc_id", "key"])
    each = wanted.drop("run").distinct()
    found = stored(found.join(F.broadcast(each) if few else each, "hash").filter("NOT folded OR runs OR item_runs")
                   .select("doc_id", "key", "class", "folded").distinct(), "candidates")
    n = found.count()
    # the candidates' texts: the few are sent to the scan of the documents, else both are shuffled
    pairs = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("class", "folded")).alias("classes"))
    pairs = pairs.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "classes")
    pairs = F.broadcast(pairs) if n <= BROADCAST_ROWS // 4 else pairs
    texts = stored(rows.join(pairs, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
                   .dropDuplicates(["__doc", "__key"]).select("doc_id", "key", "text", "classes"), "texts")
    texts = texts.select("doc_id", "key", "text", F.inline("classes"))
    here = windows(texts.filter("NOT folded"), ["doc_id", "key", "class"], "place").unionByName(
        folded_windows(texts.filter("folded"), ["doc_id", "key", "class"], "place").drop("n", "runs"))
    here = here.withColumnRenamed("slots", "values")
    same = stored(here.join(items.drop("words"), ["class", "hash"]).withColumn("shift", F.col("place") - F.col("at")), "matches")

    doc = ["doc_id", "key", "class"]
    pairs = F.transform(F.transform(
        F.filter(F.arrays_zip("slots", "values"), lambda s: s["slots"].isNotNull()),
        lambda s: F.struct(_value(s["slots"]).alias("of"), _value(s["values"]).alias("to"))), _pair)
    same = same.select(*doc, "item_id", "n_windows", "folded", "at", "shift", pairs.alias("pairs"))
    filled = same.select(*doc, "shift", F.explode("pairs").alias("s")).select(*doc, "shift", "s.of", "s.to").distinct()
    many = [F.count("*").over(Window.partitionBy(*doc, "shift", side)) > 1 for side in ("of", "to")]
    conflicts = (filled.withColumn("conflict", many[0] | many[1]).filter("conflict AND of <> to")
                 .groupBy(*doc, "shift").agg(F.collect_set(F.struct("of", "to")).alias("conflicts")))
    joined = same.alias("m").join(
        conflicts.alias("f"), [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*doc, "shift"]], "left")
    good = joined.filter(F.col("conflicts").isNull() | ~F.arrays_overlap("pairs", "conflicts"))
    each = good.groupBy(*[F.col(f"m.{c}") for c in doc], "item_id", "n_windows", "folded", "at").agg(
        F.min(F.exists("pairs", lambda s: s["of"] != s["to"])).alias("changed"))
    enough = (each.groupBy(*doc, "item_id", "n_windows", "folded").agg(
        F.count("*").alias("n_matched"), F.max("changed").alias("reparameterised"))
        .filter(F.col("n_matched") >= F.col("n_windows") * CONTAINMENT))
    # an item found word by word is not told a second time with its runs folded
    row = F.struct("folded", "n_windows", "n_matched", "reparameterised")
    return (enough.groupBy("doc_id", "key", "item_id").agg(F.min(row).alias("r"))
            .select("doc_id", "key", "item_id", "r.n_windows", "r.n_matched", "r.reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = stored(contaminated(docs, benchmark).select(
        F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS // 4 else bad
    match = (F.xxhash64(docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__doc"))
    return docs.join(bad, match, "left_anti").select(docs.columns)

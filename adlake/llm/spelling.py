"""Spelling variants: the words of a vocabulary that are one edit apart, by a bit-sliced position index.

For each (position, letter) the index has a bitset over the words of a block: those with that letter
there. A query word runs through its letters and keeps, for all words of the block at once, the set
without error so far and the sets with one: a replaced letter (positions stay), one letter less
(positions move back) or one more (positions move on). Each step is a few word-parallel operations.

Blocks keep the index small. Two words of lengths m and m or m + 1 that are one edit apart agree
before the edit and behind it; so cut at the middle, either the part before or the part behind is
equal. A block is the words of one class m that share a prefix and a suffix around an open
window; one with too many words is cut again at the middle of its window, down to a window of
one letter, where the alphabet bounds it. A pair is counted in one block alone: in the one
of the equal prefix, if the prefix is equal, else in that of the equal suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import stored
from adlake.llm.merkle import ascii_lower

RUN = r"[A-Za-zÀ-ÿ]+"
#: A block of more words is cut again while its window is longer than one letter.
BLOCK_WORDS = 1024
#: Words and letters that are indexed together in a task, in whole blocks, and queries that run together.
TOGETHER_WORDS, TOGETHER_LETTERS, QUERIES = 2048, 1 << 20, 512
NEAR = "word string, n_near long, best struct<less:long,form:string>"


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, mangle: int | None = None) -> DataFrame:
    """word, n: the words of at least ``min_length`` code points that ``docs`` (doc_id, text) have at least ``min_count`` times.

    Words are maximal runs of Latin letters, only A-Z lower-cased. With ``mangle``, a run loses a
    code point where the crc32 of ``<doc_id>:<run>`` is a multiple of it (a null id counts as empty):
    this plants misspellings. A null or empty text has no words.
    """
    run = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))
    words = docs.filter(F.col("text").isNotNull()).select("doc_id", F.explode(run).alias("run")).filter(
        F.length("run") >= min_length)
    word: Column = F.col("run")
    if mangle:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        words = words.withColumn("h", h)
        word = F.when(F.pmod(F.col("h"), F.lit(mangle)) == 0,
                      F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counts = words.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _blocks_of(words: DataFrame) -> DataFrame:
    """Each word in the classes of its own length (as the shorter) and of one less (as the longer), as one open window."""
    length = F.length("word")
    return words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter("m > 0").withColumns(
        {"i": F.lit(0), "j": F.col("m"), "key": F.lit("")})


def _halved(rows: DataFrame) -> DataFrame:
    """Each block cut at the middle of its window [i, j): before it or behind it, the words are equal."""
    mid = F.expr("i + (j - i) div 2")
    halves = F.explode(F.array(
        F.struct(mid.alias("i"), F.col("j").alias("j"), F.lit("p").alias("side")),
        F.struct(F.col("i").alias("i"), mid.alias("j"), F.lit("s").alias("side"))))
    cut = rows.select("word", "n", "m", halves.alias("h")).select("word", "n", "m", "h.i", "h.j")
    return cut.filter("j > i").withColumn("key", F.concat(
        F.substr("word", F.lit(1), F.col("i")), F.lit(" "), F.substr("word", F.length("word") - F.col("m") + F.col("j") + 1)))


def blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """word, n, m, i, j, key: the blocks (m, i, j, key) of ``words`` that have a word of length m and one more, none too large.

    The counts of the blocks are joined back, so nothing is gathered; each round halves the windows of
    the blocks that are too large.
    """
    block, out = ["m", "i", "j", "key"], None
    rows = _halved(_blocks_of(words))
    while True:
        rows = stored(rows, "blocks")
        sizes = (rows.groupBy(*block).agg(F.count("*").alias("size"), F.min(F.length("word")).alias("least"))
                 .filter("size > 1 AND least = m").drop("least"))   # longer words alone are near in the next class
        sized = stored(rows.join(sizes, block), "sized-blocks")
        large = (F.col("size") > most) & (F.col("j") - F.col("i") > 1)
        done = sized.filter(~large).select("word", "n", *block)
        out = done if out is None else out.unionByName(done)
        rows = sized.filter(large)
        if rows.isEmpty():
            return out
        rows = _halved(rows)


class Index:
    """Bitsets over ``words`` for every (position, letter) that occurs; bit k stands for word k."""

    def __init__(self, words: list[str]):
        self.size = len(words)
        self.width = -(-len(words) // 64)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        word = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(letters)) - self.starts[word]
        self.alphabet, code = np.unique(letters, return_inverse=True)
        slot = place * len(self.alphabet) + code
        self.slots, row = np.unique(slot, return_inverse=True)
        self.bits = self.sets(row, word, len(self.slots) + 1)   # the last is empty: for what does not occur
        self.letters, self.code = letters, code

    def sets(self, row: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
        """``rows`` bitsets; word[k] is in row[k]."""
        out = np.zeros((rows, self.width * 64), bool)
        out[row, word] = True
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def row(self, place: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Row of the bitset of each (place, letter)."""
        want = place * len(self.alphabet) + code
        at = np.searchsorted(self.slots, want)
        at[at == len(self.slots)] = 0
        return np.where((self.slots[at] == want) & (place >= 0), at, len(self.slots))

    def near(self, queries: np.ndarray, before: np.ndarray):
        """Bitsets of the words one edit from each of ``queries`` (word numbers, longest first).

        ``before[k]`` letters (if not 0) at the start of query k must not all be equal, else a pair is left out.
        Yields, for all queries at once, the sets of words as long, one letter shorter, and one longer.
        """
        lengths, starts = self.lengths[queries], self.starts[queries]
        shape = (len(queries), self.width)
        zero = np.full(shape, ~np.uint64(0))
        changed, less, more, equal = (np.zeros(shape, np.uint64) for _ in range(4))
        for i in range(int(lengths[0]) if len(lengths) else 0):
            k = int(np.searchsorted(-lengths, -i, "left"))   # queries with a letter at i
            stop = np.flatnonzero(before[:k] == i) if i else ()
            if len(stop):
                equal[stop] = zero[stop]
            code, place = self.code[starts[:k] + i], np.full(k, i)
            here = self.bits[self.row(place, code)]
            z, c, s, m = zero[:k], changed[:k], less[:k], more[:k]
            m |= z
            m &= self.bits[self.row(place + 1, code)]      # the other word has one letter more before this one
            s &= self.bits[self.row(place - 1, code)]
            s |= z                                        # the other word lacks this letter
            c &= here
            c |= z & ~here
            z &= here
        return changed & ~equal, less & ~equal, (more | zero) & ~equal


def _found(words: list[str], n: np.ndarray, m: np.ndarray, j: np.ndarray, block: np.ndarray):
    """(word number, near words, number of the best) of the words of some whole blocks; words ascend by rank in each block."""
    index = Index(words)
    by_length, length_row = np.unique(index.lengths, return_inverse=True)
    numbers = np.arange(index.size)
    of_block = index.sets(block, numbers, int(block.max()) + 1)
    of_length = np.vstack([index.sets(length_row, numbers, len(by_length)), np.zeros((1, index.width), np.uint64)])

    def length_set(want: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(by_length, want), len(by_length) - 1)
        return of_length[np.where(by_length[at] == want, at, len(by_length))]

    order = np.argsort(-index.lengths, kind="stable")
    for a in range(0, len(order), QUERIES):
        q = order[a:a + QUERIES]
        shorter = index.lengths[q] == m[q]
        changed, less, more = index.near(q, np.where(j[q] < m[q], j[q], 0))
        near = changed & length_set(index.lengths[q]) & np.where(shorter, ~np.uint64(0), np.uint64(0))[:, None]
        near |= more & length_set(index.lengths[q] + 1) & np.where(shorter, ~np.uint64(0), np.uint64(0))[:, None]
        near |= less & length_set(index.lengths[q] - 1) & np.where(shorter, np.uint64(0), ~np.uint64(0))[:, None]
        near &= of_block[block[q]]
        count = np.bitwise_count(near).sum(axis=1)
        hit = np.flatnonzero(count)
        first = (near[hit] != 0).argmax(axis=1)
        low = near[hit, first]
        bit = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        yield q[hit], count[hit].astype(np.int64), first * 64 + bit


def near_words(rows: DataFrame) -> DataFrame:
    """word, n_near, best (of largest n, then smallest) from ``blocks``: a row per word that has near words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(held):
            words, n, m, _, j, _ = zip(*held)
            keys = [(r[2], r[3], r[4], r[5]) for r in held]
            block = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:]))])
            n, m, j = (np.array(x, np.int64) for x in (n, m, j))
            for q, count, best in _found(list(words), n, m, j, block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[k] for k in q.tolist()], pa.string()), pa.array(count),
                     pa.StructArray.from_arrays([pa.array(-n[best]), pa.array([words[k] for k in best.tolist()], pa.string())],
                                                ["less", "form"])], ["word", "n_near", "best"])

        key, start, letters = None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2:] != key:
                    if len(held) >= TOGETHER_WORDS or letters >= TOGETHER_LETTERS:
                        yield from found(held)
                        held, letters = [], 0
                    key = row[2:]
                held.append(row)
                letters += len(row[0])
        if held:
            yield from found(held)

    block = ["m", "i", "j", "key"]
    parts = (rows.repartition(*block).sortWithinPartitions(*block, F.desc("n"), "word")
             .select("word", "n", *block).mapInArrow(run, NEAR))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: follows ``forms`` (word, form) to the last, by doubling; each form is commoner, so there are no cycles."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = ways.select(F.col("word").alias("__at"), F.col("root").alias("__on"))
        longer = stored(ways.join(on, F.col("root") == F.col("__at"), "left")
                        .select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("moved")), "roots")
        ways = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return ways


def grouped(words: DataFrame, times: int = 10, most: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n; each word once, null words left out).

    A near word is one edit away. A word's form is its near word of largest n, the smallest in
    code-point order among ties, if that is at least ``times`` its own n. The root is the last form.
    """
    words = stored(words.filter(F.col("word").isNotNull()).select("word", F.col("n").cast("long")), "words")
    near = stored(words.join(near_words(blocks(words, most)), "word", "left")
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(-F.col("best.less") >= F.col("n") * times, F.col("best")).alias("best")), "near")
    roots = rooted(near.filter(F.col("best").isNotNull()).select("word", F.col("best.form").alias("form")))
    return near.join(roots, "word", "left").select(
        "word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        (-F.col("best.less")).alias("form_n"))

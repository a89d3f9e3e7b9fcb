"""Language identification by compression.

Each language has a raw-content Zstandard dictionary, cut from a bounded sample of labelled
texts. A text is encoded piece by piece with every dictionary; the language whose dictionary
gives the smallest total is chosen, and the lead over the next one is the score. A narrow lead
is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import stored, to_tasks

UNKNOWN = "und"
LETTER = r"\p{L}"
RESULT = "lang_pred string, score double, rejected boolean"
#: Bytes that say nothing of the language are dropped, ASCII letters lower-cased.
_NOISE = bytes(i for i in range(33, 128) if not chr(i).isalpha())
_LOWER = bytes(32 if i < 32 else i for i in range(256)).lower()


def _plain(raw: bytes) -> bytes:
    return raw.translate(_LOWER, _NOISE)


@dataclass(frozen=True)
class Model:
    dictionaries: dict[str, bytes]
    level: int = 3
    piece: int = 1024

    def coders(self) -> dict[str, zstandard.ZstdCompressor]:
        out = {}
        for lang, data in self.dictionaries.items():
            made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=self.level)
            out[lang] = self._coder(dict_data=made)
        return out

    def _coder(self, **more) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(
            level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False, **more)

    def judge(self, raw: bytes, coders: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float]:
        """The language of a text with at least one letter, and its lead from 0 to 1."""
        plain = _plain(raw)
        pieces = [plain[i:i + self.piece] for i in range(0, len(plain), self.piece)] or [b""]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in coders.items())
        if len(sizes) == 1:  # the lead is then over no dictionary at all
            bare = self._coder()
            sizes.append((sum(len(bare.compress(p)) for p in pieces), ""))
        (best, lang), (second, _) = sizes[:2]
        return lang, max(0.0, (second - best) / second)


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(labelled: DataFrame, dictionary_bytes: int = 1 << 17, excerpt: int = 1024,
          texts_per_language: int = 512, max_languages: int = 512) -> Model:
    """Dictionaries from the columns ``text`` and ``lang``; rows with a null or letterless text or null lang are skipped.

    The sample is bounded: of each language the ``texts_per_language`` distinct texts of least
    hash, and of each of them ``excerpt`` characters from a place that the hash picks, until
    ``dictionary_bytes`` are filled. More than ``max_languages`` languages are an error, so the
    model never exceeds ``max_languages * dictionary_bytes``.
    """
    rows = (labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
            .select("lang", "text", F.xxhash64("text").alias("rank")))
    ranks = stored(rows.select("lang", "rank"), "ranks")
    sizes = stored(ranks.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n")), "languages")
    if sizes.count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # of a large language only about four times the wanted number reach the sort
    near = F.pmod(F.col("rank"), F.lit(1 << 30)) < F.lit(4.0 * texts_per_language * (1 << 30)) / F.col("n")
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("rank"), F.lit(1 << 30)), "rank")
    chosen = (ranks.join(F.broadcast(sizes), "lang").filter(near).groupBy("lang", "rank").count()
              .withColumn("place", F.row_number().over(order))
              .filter(F.col("place") <= texts_per_language).select("lang", "rank"))
    start = F.pmod("rank", F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1
    cut = F.substr("text", start.cast("int"), F.lit(excerpt))
    found = (rows.join(F.broadcast(chosen), ["lang", "rank"])
             .groupBy("lang", "rank").agg(F.min(cut).alias("cut")).orderBy("lang", "rank").collect())
    dictionaries: dict[str, bytes] = {}
    for row in found:
        so_far = dictionaries.get(row["lang"], b"")
        dictionaries[row["lang"]] = (so_far + _plain(row["cut"].encode()) + b" ")[:dictionary_bytes]
    return Model({k: v for k, v in dictionaries.items() if len(v.strip()) >= 8})


def identified(docs: DataFrame, model: Model, text: str = "text", min_margin: float = 0.002) -> DataFrame:
    """``docs`` with a struct ``language`` of lang_pred, score and rejected.

    lang_pred is ``und`` with score 0, and rejected, where the text is null or has no letter,
    or no language was learned. A lead below ``min_margin`` is rejected but keeps its language.
    """
    shared = to_tasks(docs.sparkSession, model)

    @F.arrow_udf(RESULT)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = cloudpickle.loads(shared.value)
        coders = model.coders()
        for batch in texts:
            got = [(UNKNOWN, 0.0) if raw is None or not coders else model.judge(raw, coders)
                   for raw in batch.cast(pa.large_binary()).to_pylist()]
            lang, score = (list(x) for x in zip(*got)) if got else ([], [])
            rejected = [k == UNKNOWN or s < min_margin for k, s in got]
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["lang_pred", "score", "rejected"])

    return docs.withColumn("language", judge(F.when(F.col(text).rlike(LETTER), F.col(text))))


def learned_from(docs: DataFrame) -> Model:
    """The model of all documents that are not held out."""
    return learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with their own columns."""
    judged = identified(docs.select(F.struct("*").alias("__row"), F.col("text")), learned_from(docs))
    return judged.filter(~F.col("language.rejected")).select("__row.*")

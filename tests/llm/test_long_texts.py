"""Very long texts through the operators whose own tests have none, and language ID against a plain loop."""

import re

import zstandard
from helpers import rows
from test_decontaminate import ITEM

from adlake.llm import langid, queries


def documents(spark, folder, texts):
    data = [(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(folder / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_mixing_and_sharding(spark, tmp_path):
    texts = ["word é " * 400_000, *(f"text {i} " * 40 for i in range(50))]
    folder = documents(spark, tmp_path, texts)
    mixed = {r["doc_id"]: r for r in rows(queries.QUERIES["op2_mix_sources"](spark, folder))}
    assert mixed[0]["size"] == 800_000 and len(mixed) == 51 and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed.values())
    sharded = {r["doc_id"]: r for r in rows(queries.QUERIES["op9_sharding"](spark, folder))}
    assert sharded[0]["size"] == len(texts[0].encode()) + 8 and len(sharded) == 51


def test_decontamination(spark, tmp_path):
    filler = "plain filler words without any names here " * 30_000
    folder = documents(spark, tmp_path, [filler + ITEM + " " + filler, filler, "short"])
    assert [(r["doc_id"], r["item_id"]) for r in rows(queries.QUERIES["op5_benchmark_decontamination"](spark, folder))] == [(0, 1)]


def test_url_filter(spark, tmp_path):
    html = "<a href='http://good.example.net/en/x'>x</a>" * 100_000
    pages = [(1, "http://a.net/x", html), (2, "http://good.example.net/en/x", "<p>"), (3, "http://b.org/" + "p" * 1_000_000, html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["host"], len(r["path"]), r["rule"]) for r in rows(queries.QUERIES["op6_url_filter"](spark, str(tmp_path)))}
    assert got == {1: ("a.net", 2, "net/"), 2: ("good.example.net", 5, "example.net/en/"), 3: ("b.org", 1_000_001, None)}


def test_language_equals_a_plain_loop_over_the_dictionaries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    texts = [(r["doc_id"], r["text"]) for r in rows(docs)] + [(10_000, "Äpfel, und 12 the of é " * 40_000), (10_001, "12 34"), (10_002, None)]
    model = langid.learned_from(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r["doc_id"]: r["language"] for r in rows(langid.identified(spark.createDataFrame(texts, "doc_id long, text string"), model))}
    lower = {i: 32 if i < 32 else ord(chr(i).lower()) if i < 128 else i for i in range(256)}
    for doc, text in texts:
        if not text or not re.search(r"[^\W\d_]", text):
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0)
            continue
        raw = bytes(lower[b] for b in text.encode() if not (32 < b < 128 and not chr(b).isalpha()))
        sizes = {}
        for lang, dictionary in model.dictionaries.items():
            known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=model.level)
            coder = zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(raw[i:i + model.piece])) for i in range(0, max(len(raw), 1), model.piece))
        first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        assert got[doc]["lang_pred"] == first[0] and abs(got[doc]["score"] - (second[1] - first[1]) / second[1]) < 1e-12

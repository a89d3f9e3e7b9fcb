"""Each stage of the pipeline on its own input, against plain Python."""

import collections

import pytest
from helpers import groups_of, rows, words
from test_simhash import plain_fingerprint

import corpus_pipeline
from adlake.llm import langid


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = (rows(docs), rows(spark.read.parquet(path)), docs.columns)
        docs = spark.read.parquet(path)
    return out


def test_language_keeps_what_is_not_rejected(spark, sf_dir, stages):
    before, after, columns = stages["language_id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = {r["doc_id"]: r["language"]["rejected"] for r in rows(langid.identified(docs, langid.learned_from(docs)))}
    assert {r["doc_id"] for r in after} == {i for i, bad in judged.items() if not bad}
    assert len(after) > 0.97 * len(before) and list(after[0]) == columns


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["simhash_near_dedup"]
    fps = [plain_fingerprint(r["text"], 3) for r in before]
    root = groups_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for r, g in zip(before, root):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())


def test_documents_with_items_go(spark, sf_dir, stages):
    before, after, _ = stages["benchmark_decontamination"]
    items = [" ".join(words(r["text"])) for r in rows(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))]
    holds = {r["doc_id"] for r in before if any(i in " ".join(words(r["text"])) for i in items)}
    kept = {r["doc_id"] for r in after}
    assert not holds & kept and len(before) - len(kept) <= 1.5 * len(holds) + 1


def test_mix_repeats_whole_rows(stages):
    before, after, columns = stages["mix_sources"]
    rows_in = {str(r) for r in before}
    times = collections.Counter(map(str, after))
    assert set(times) <= rows_in and max(times.values()) <= 2 and list(after[0]) == columns
    total = sum(len(words(r["text"])) for r in before)
    assert sum(len(words(r["text"])) for r in after) == pytest.approx(1.5 * total, rel=0.15)


def test_shards_hold_every_row(stages):
    before, after, columns = stages["sharding"]
    assert collections.Counter(r["doc_id"] for r in before) == collections.Counter(r["doc_id"] for r in after)
    sizes = collections.Counter(r["shard"] for r in after)
    assert max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1 and list(after[0]) == [*columns, "shard", "slot"]


def test_odd_tables_pass_all_stages(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies string, __row string"
    odd = [(1, None, None, None, None, "", "", ""), (None, "", "en", "a", 0, "", "", ""), (2, "word", "en", None, 4, "", "", "")] * 3
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() <= len(odd) * 2 and set(docs.columns) == {*schema.replace(" string", "").replace(" long", "").split(", "), "slot"}

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from helpers import rows

from adlake.llm import spelling
from adlake.llm.queries import op11_spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, times=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= times * n else None, n, len(near))
    roots = {}
    for w in counts:
        at = w
        while out[at][0]:
            at = out[at][0]
        roots[w] = at
    return {w: (form, roots[w], n, k, counts[form] if form else None) for w, (form, n, k) in out.items()}


def outcome(df):
    got = rows(df)
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def some_words(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(150)}
    words |= {"common" + a + b for a, b in itertools.product("abcdé", "xyzÿ")} | {"x" * k for k in range(1, 14)}
    words |= {"l" * 3000, "l" * 2999 + "k", "l" * 2999, "q" * 1500 + "l" * 1499, "é" * 8, "é" * 9}
    return {w: int(10 ** rng.uniform(0, 5)) for w in words}


@pytest.mark.parametrize(("seed", "most"), [(1, 1024), (2, 2), (3, 20)])
def test_near_words_forms_and_roots(spark, seed, most):
    counts = some_words(seed)
    words = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n int").repartition(3)
    assert outcome(spelling.grouped(words, most=most)) == plain(counts)


def test_index_against_all_pairs():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(300)}, key=lambda w: -len(w))
    index = spelling.Index(words)
    sets = index.near(np.arange(len(words)), np.zeros(len(words), int))
    for found, more in zip(sets, (0, -1, 1)):
        bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little").astype(bool)
        for a, b in itertools.product(range(len(words)), repeat=2):
            if len(words[b]) == len(words[a]) + more:
                assert bits[a, b] == one_edit(words[a], words[b]), (words[a], words[b])


def test_windows_shrink_until_blocks_are_small(spark):
    words = spark.createDataFrame([("prefix" + a + b + "suffix", 1) for a, b in itertools.product("abcdefghij", repeat=2)],
                                  "word string, n long")
    got = rows(spelling.blocks(words, most=12))
    sizes = collections.Counter((r["m"], r["i"], r["j"], r["key"]) for r in got)
    assert max(sizes.values()) <= 12 and min(sizes.values()) > 1 and {m for m, *_ in sizes} == {14}


def test_chains_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("a", "w3"), ("b", "c")]
    got = {r["word"]: r["root"] for r in rows(spelling.rooted(spark.createDataFrame(forms, "word string, form string")))}
    assert got == {**{f"w{i}": "w18" for i in range(18)}, "a": "w18", "b": "c"}


def plain_words(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(9)
    base = ["Wordings", "ÉCOLIERS", "letters×es", "short", "umlautÄß", "abcdefg"]
    docs = [(rng.choice([None, *range(40)]), " ".join(rng.choices(base, k=60)) + ",1x") for _ in range(60)]
    docs += [(1, None), (2, ""), (3, "12 !"), (4, "wordingz wordingz"), (5, "Wordings " * 200_000), (6, "h" * 100_000 + " " + "h" * 100_000)] * 2
    data = [(i, text, "w", 1, "x", "y") for i, text in docs]
    schema = "doc_id long, text string, word string, n int, run string, h string"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = outcome(op11_spelling_variants(spark, str(tmp_path))), plain(plain_words(docs))
    assert got == want and len(want) > 10
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert outcome(op11_spelling_variants(spark, str(tmp_path / "none"))) == {}

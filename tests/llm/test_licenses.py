import math
import random
import statistics
import textwrap
from collections import Counter

import pytest
from helpers import rows

from adlake.llm import licenses

SCHEMA = "id long, path string, text string, license string, whole string"
MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def scan(spark, data, **how):
    files = spark.createDataFrame([(i, p, t, "x", "y") for i, p, t in data], SCHEMA)
    return {r["id"]: (r["license"], r["origin"], r["from_directory"]) for r in rows(licenses.scanned(files, ["id"], **how))}


def test_own_and_inherited(spark):
    data = [(1, "a/LICENSE", MIT), (2, "a/b/c.py", "code here"), (3, "a/b/LICENSE.txt", f"text\n{APACHE}\nmore"), (4, "a/b/d/e.py", None),
            (5, "top.py", "x"), (6, "z/f.py", "# " + MIT), (7, "z/g.py", ""), (8, None, "x"), (9, "ab/c.py", "x"), (10, "a/x.py", "all rights reserved"),
            (11, "/root/COPYING", APACHE), (12, "/root/deep/er/file", "x"), (13, "a/b/c.py", "code here"), (14, None, MIT)]
    got = scan(spark, data)
    assert got == {1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "inherited", "a/b"),
                   5: (None, None, None), 6: ("MIT", "own", None), 7: (None, None, None), 8: (None, None, None), 9: (None, None, None),
                   10: ("LicenseRef-reserved", "own", None), 11: ("Apache-2.0", "own", None), 12: ("Apache-2.0", "inherited", "/root"),
                   13: ("Apache-2.0", "inherited", "a/b"), 14: ("MIT", "own", None)}


def test_top_directory_and_ties(spark):
    data = [(1, "LICENSE-b", APACHE), (2, "COPYING-a", MIT), (3, "x/y", ""), (4, "z", "w " * 300_000)]
    got = scan(spark, data)
    assert got[3] == ("MIT", "inherited", "") and got[4] == ("MIT", "inherited", "")


def test_best_equals_plain_cosines_of_all_windows():
    rng = random.Random(6)
    known = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words(t)})
    spread, files = {w: rng.randrange(90) for w in known[::2]}, 100
    idf = {w: 1 - math.log((1 + spread.get(w, 0)) / 101) for w in known}
    unseen = statistics.median(idf.values())

    def weights(some):
        return {w: n * idf.get(w, unseen) for w, n in Counter(some).items()}

    def cosine(a, b):
        dot = sum(x * b.get(w, 0) for w, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    def best(text, threshold):
        every, found = licenses.words(text), []
        for name, template in licenses.TEMPLATES:
            t = licenses.words(template)
            least = max(threshold, licenses.SHORT_THRESHOLD) if len(t) < licenses.SHORT else threshold
            for i in range(max(len(every) - len(t), 0) + 1 if every else 0):
                c = round(cosine(weights(every[i:i + len(t)]), weights(t)), 9)
                if c >= least:
                    found.append((-round(c * math.log(1 + len(t)), 9), name, -c))
        e, name, c = min(found, default=(None, None, None))
        return name and (-e, name, -c)

    hits = 0
    for threshold in (0.8, 0.4):
        matcher = licenses.Matcher(list(licenses.TEMPLATES), spread, files, threshold)
        for _ in range(60):
            t = licenses.words(rng.choice(licenses.TEMPLATES)[1])
            t = t[:rng.randrange(len(t) + 1)] + rng.choices(["x", "the", "y"], k=rng.randrange(6)) + t[rng.randrange(len(t)):]
            text = " ".join(rng.choices(["x", "the", "license", "z"], k=rng.randrange(9)) + t + rng.choices(["of", "q", "rights"], k=5))
            want = best(text, threshold)
            got, hits = matcher.best(text), hits + bool(want)
            assert got == (pytest.approx(want, abs=2e-9) if want else None)
    assert hits > 40


@pytest.mark.parametrize("files", [1_000, 100_000_000])
def test_real_files_whatever_the_number_of_files(files):
    common = {"the": .6, "of": .5, "and": .5, "or": .4, "to": .5, "in": .5, "a": .5, "this": .3, "license": .05, "version": .02, "under": .1,
              "all": .1, "rights": .01, "reserved": .008, "software": .02, "is": .4, "any": .1, "copyright": .02}
    matcher = licenses.Matcher(list(licenses.TEMPLATES), {w: int(x * files) for w, x in common.items()}, files, licenses.THRESHOLD)

    def wrapped(text, lead="", width=60):
        return "\n".join(lead + line for line in textwrap.wrap(text, width))

    def text_of(name):
        return max((t for n, t in licenses.TEMPLATES if n == name), key=len)

    owner = "Copyright (c) 2020, Acme Holdings\nAll rights reserved.\n\n"
    filler = "\n" + "some code and the rest of it " * 40
    cases = [(owner + wrapped(text_of("BSD-3-Clause")), "BSD-3-Clause"), (owner + wrapped(text_of("BSD-2-Clause"), " * "), "BSD-2-Clause"),
             (owner + wrapped(text_of("BSD-3-Clause").replace("the copyright holder nor", "Acme Holdings nor").replace("COPYRIGHT HOLDERS", "REGENTS")), "BSD-3-Clause"),
             ("MIT License\n\n" + owner + wrapped(text_of("MIT"), width=44), "MIT"), (wrapped(text_of("ISC"), "// ", 30) + filler, "ISC"),
             ("/* " + owner + "\n" + wrapped("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at", " * ", 30) + filler, "Apache-2.0"),
             ("Copyright Acme. Released under the MIT License." + filler, "MIT"), ("// Released under\n// the MIT License" + filler, "MIT"),
             (wrapped(text_of("GPL-2.0"), "# ") + filler, "GPL-2.0"), (wrapped(text_of("GPL-3.0"), "# ") + filler, "GPL-3.0"), ("x " + owner + filler, "LicenseRef-reserved"),
             ("Some rights reserved.", None), ("No rights reserved" + filler, None), ("Released under the XYZ License.", None), (filler, None), ("", None), (None, None)]
    assert [m and m[1] for m in (matcher.best(text) for text, _ in cases)] == [name for _, name in cases]


def test_empty_table_and_too_many_words(spark, monkeypatch):
    assert scan(spark, []) == {}
    monkeypatch.setattr(licenses, "MAX_TERMS", 3)
    with pytest.raises(ValueError):
        scan(spark, [(1, "a", "b")])

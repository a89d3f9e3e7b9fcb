"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every window of a file's words that is as long as a template, across line breaks, is a sparse vector of
word counts times inverse document frequency; the frequencies are counted over all files. Its cosine to
the template is bounded first by sums over the file and the window, and taken in full where the bound
reaches the threshold. Of the templates found the one with the most evidence is the file's own licence:
cosine times the logarithm of the template's length, so that a licence text goes before a notice of a
few words inside it. A licence file's licence also holds for its directory, and files without a licence
of their own take that of the nearest directory above them that has one.
"""

from __future__ import annotations

import math
import statistics
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import stored, to_tasks

_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.")
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Notices that name a licence, licence texts, and the openings of long licence texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
            "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
            "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
            "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
            "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
            "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("LicenseRef-reserved", "All rights reserved."),
)
THRESHOLD = 0.8
#: Templates of fewer words must be met whole but for one common word: another word is another licence.
SHORT, SHORT_THRESHOLD = 8, 0.95
#: A word in fewer of the files than this share weighs no more, so weights do not grow with the number of files.
RAREST = 1e-4
#: Names of files whose licence holds for their directory.
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([-_.].*)?$"
EDGES = ".,;:!?\"'()[]{}*#/<>"
MAX_TERMS = 1_000_000


def words(passage: str) -> list[str]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation at their ends."""
    edges = EDGES.encode()
    return [w.decode() for w in (x.strip(edges) for x in passage.encode().lower().split()) if w]


class Matcher:
    """Cosines of a text's windows to the templates.

    ``spread`` says in how many of the ``files`` each word stands. A word of no template weighs as much as
    the middle one of the templates' words.
    """

    def __init__(self, templates: list[tuple[str, str]], spread: dict[str, int], files: int, threshold: float):
        counts = [Counter(words(text)) for _, text in templates]
        self.names = [name for name, _ in templates]
        self.lengths = [c.total() for c in counts]
        self.thresholds = [max(threshold, SHORT_THRESHOLD) if n < SHORT else threshold for n in self.lengths]
        self.rows = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
        self.idf = np.array([1 - math.log(max((1 + spread.get(w, 0)) / (1 + files), RAREST)) for w in self.rows])
        self.unseen = statistics.median(self.idf) if self.rows else 1.0
        self.weights = np.array([[c[w] for c in counts] for w in self.rows]).reshape(len(self.rows), len(counts))
        self.weights = self.weights * self.idf[:, None]
        self.norms = np.sqrt((self.weights ** 2).sum(axis=0))

    def best(self, text: str | None) -> tuple[float, str, float] | None:
        """Evidence, licence and cosine of the best window (of equals the first licence by name), if one is found."""
        all_words = words(text or "")
        known = [self.rows[w] for w in set(all_words).intersection(self.rows)]
        # no window has a greater cosine than the part of a template that lies on the text's words
        least = np.array(self.thresholds) * self.norms * (1 - 1e-9)
        open_ = np.flatnonzero((self.weights[known] ** 2).sum(axis=0) >= least ** 2) if known else ()
        if not len(open_):
            return None
        codes: dict[str, int] = {}
        at = np.fromiter((codes.setdefault(w, len(codes)) for w in all_words), np.int64, len(all_words))
        rows = np.array([self.rows.get(w, -1) for w in codes])
        idf = np.where(rows < 0, self.unseen, self.idf[rows])
        squares = np.concatenate([[0], np.cumsum((idf ** 2)[at])])
        found = []
        for i in open_:
            share = np.where(rows < 0, 0, self.weights[rows, i]) * idf          # of the dot product, a word
            size = min(self.lengths[i], len(at))
            dots = np.concatenate([[0], np.cumsum(share[at])])
            # a window's norm is least where no word comes twice
            dots, low = dots[size:] - dots[:-size], squares[size:] - squares[:-size]
            for start in np.flatnonzero(dots >= least[i] * np.sqrt(np.maximum(low, 0)) * (1 - 1e-6)):
                code, n = np.unique(at[start:start + size], return_counts=True)
                dot, norm = (n * share[code]).sum(), math.sqrt(((n * idf[code]) ** 2).sum())
                cosine = round(float(dot / (norm * self.norms[i])), 9)
                if cosine >= self.thresholds[i]:
                    found.append((-round(cosine * math.log(1 + self.lengths[i]), 9), self.names[i], -cosine))
        evidence, name, cosine = min(found, default=(None, None, None))
        return None if name is None else (-evidence, name, -cosine)


def _spread(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many files each word of the templates stands, and the number of files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[""] += 1
                if text:
                    counts.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = files.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    spread = {r["word"]: r["n"] for r in rows}          # at most the templates' words
    return spread, spread.pop("", 0)


def matched(files: DataFrame, keys: list[str], templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``keys``, ``license`` and ``cosine`` of ``files`` (keys, text); null where no window matches.

    Null and blank texts match nothing; a text shorter than a template is one window. Templates of fewer than
    ``SHORT`` words take ``SHORT_THRESHOLD``. Of equal evidence the first licence by name wins.
    """
    vocabulary = {w for _, t in templates for w in words(t)}
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"templates hold more than {MAX_TERMS} words")
    shared = to_tasks(files.sparkSession, Matcher(templates, *_spread(files, vocabulary), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = cloudpickle.loads(shared.value)
        for batch in batches:
            out = [matcher.best(text) or (None, None, None) for text in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array([n for _, n, _ in out], pa.string()),
                 pa.array([c for _, _, c in out], pa.float64())], [*keys, "license", "cosine"])

    source = files.select(*keys, "text")
    schema = source.select(keys).schema.add("license", "string").add("cosine", "double")
    return source.mapInArrow(run, schema)


def directory(path: Column) -> Column:
    """Everything before the last ``/``; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The directory itself and all above it, down to the empty path; the depth is the place from the top."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def scanned(files: DataFrame, keep: list[str], templates: tuple[tuple[str, str], ...] = TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, path, license, cosine, origin and from_directory of ``files`` (keep, path, text).

    origin is ``own`` or ``inherited``, null without a licence; from_directory is the directory a
    licence was inherited from. In a directory the licence file of greatest cosine counts, then the
    first by path. A null path has no directory and inherits nothing. Repeated rows come back as often.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    licence_file = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    rows = files.select(*keep, "path", "text", licence_file.alias("__file"), directory(F.col("path")).alias("__dir"))
    own = stored(matched(rows, [*keep, "path", "__file", "__dir"], list(templates), threshold), "own-licences")
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license"))
    declared = (own.filter("__file AND license IS NOT NULL AND __dir IS NOT NULL").groupBy("__dir").agg(best.alias("b"))
                .select(F.col("__dir").alias("above"), F.col("b.license").alias("theirs")))
    folders = own.filter("license IS NULL AND __dir IS NOT NULL").select("__dir").distinct()
    up = folders.select("__dir", F.posexplode(ancestors(F.col("__dir"))).alias("depth", "above"))
    nearest = (up.join(declared, "above").groupBy("__dir")
               .agg(F.max(F.struct("depth", "above", "theirs")).alias("n"))
               .select("__dir", F.col("n.above").alias("above"), F.col("n.theirs").alias("theirs")))
    out = own.join(nearest, "__dir", "left")
    given = F.col("license").isNull() & F.col("theirs").isNotNull()
    return out.select(*keep, "path", F.coalesce("license", "theirs").alias("license"), "cosine",
                      F.when(F.col("license").isNotNull(), "own").when(given, "inherited").alias("origin"),
                      F.when(given, F.col("above")).alias("from_directory"))

"""License scans by diagonal voting.

All rolling word k-grams of all documents, as hashes with their positions, are joined with the positions that they have in
the templates. Hits of a document and template vote for their offset (diagonal); neighbouring diagonals, as a word
put in or left out makes them, are merged to groups no wider than the template; and around the groups that got votes
enough the texts are verified word by word. Of what is verified the best alignment is taken out, and what is left on
either side is aligned again, so that every occurrence is reported, however close to another one. Words are runs of letters and
digits in lower case.

An occurrence has MIN_WORDS of the template's words in order and MIN_VOTES of its k-grams whole, in at most LONGEST times as many words and SLACK
more, and between two runs of it no more than SLACK words were put in or left out. k is GRAM, or less for templates so short that
changing as many words as this allows could break all their k-grams (the pigeonhole bound).

The templates are a parameter of fixed size, whose join is a broadcast; a list of templates too long for that is shuffled. Most are
whole licences with their SPDX ids, others the short notices that stand for one.

Defined cases: null and empty texts have no spans; occurrences of one template in one text never overlap, those of different templates may; repeated
rows are reported each, also those without an id; a template of fewer than two words can't be found and is refused; texts of any length are scanned whole; an
empty table has no spans; other columns are ignored.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import SIGNS, arrow_map, cut, join_checked, room, row_of, shingles, size_of, slices, text_of, word_hashes, word_spans

GRAM = 3
#: Diagonals that are at most so far apart are neighbours.
SLACK = 4
#: A share of the template's k-grams that must be whole, and of its words that must be found in order.
MIN_VOTES, MIN_WORDS = 0.2, 0.8
LONGEST = 1.25

#: Texts of licences and notices, with the SPDX id of the licence that each stands for.
_SOFTWARE_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "all-rights-reserved": "All rights reserved",
    "mit": _MIT_GRANT,
    "mit-whole": f"{_MIT_GRANT} {_SOFTWARE_AS_IS}",
    "isc": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    "0bsd": f"{_ISC_GRANT}. {_ISC_AS_IS}",
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_AS_IS}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_AS_IS}",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        f"We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_SOFTWARE_AS_IS.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')}"
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
SPDX = {
    "apache-2.0-notice": "Apache-2.0", "apache-2.0-header": "Apache-2.0", "gpl-3.0-notice": "GPL-3.0-only", "gpl-3.0-header": "GPL-3.0-or-later", "mit-notice": "MIT", "mit": "MIT", "mit-whole": "MIT",
    "cc-by-nc-4.0-notice": "CC-BY-NC-4.0", "isc": "ISC", "0bsd": "0BSD", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "zlib": "Zlib", "unlicense": "Unlicense", "mpl-2.0": "MPL-2.0",
}


def _words(text: str) -> list[bytes]:
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), SIGNS)
    return [bytes(data[a:b]) for a, b in zip(starts, ends)]


def gram_of(size: int, gram: int = GRAM) -> int:
    """The k for a template of so many words: as many changes as are allowed can't break all of its k-grams."""
    allowed = size - int(np.ceil(MIN_WORDS * size))
    return max(2, min(gram, size // (allowed + 1)))


def _hashes(data: np.ndarray, offsets: np.ndarray, grams: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and hash of each k-gram, for every k."""
    starts, ends, first = word_spans(data, offsets, SIGNS)
    left, row, words = room(first), row_of(first), word_hashes(data, starts, ends)
    found = []
    for k in grams:
        ok = np.flatnonzero(left >= k)
        found.append((row[ok], ok - first[row[ok]], shingles(words, k)[ok] + np.uint64(k)))
    return tuple(np.concatenate(x) for x in zip(*found))


def positions(spark: SparkSession, templates: dict[str, str], gram: int = GRAM) -> tuple[DataFrame, list[int]]:
    """Rows _gram, _template, _at, _size (words of the template), _grams (how many k-grams it has); and the ks."""
    rows, ks = [], set()
    for name, text in templates.items():
        size = len(_words(text))
        if size < 2:
            raise ValueError(f"template {name} has fewer than two words")
        ks.add(k := gram_of(size, gram))
        data = np.frombuffer(text.lower().encode(), np.uint8)
        _, at, h = _hashes(data, np.array([0, len(data)]), [k])
        rows += [(int(x), name, int(i), size, len(at)) for i, x in zip(at, h.view(np.int64))]
    return spark.createDataFrame(rows, "_gram bigint, _template string, _at int, _size int, _grams int"), sorted(ks)


def _grams(ks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(pc.utf8_lower(batch.column("_t").fill_null("")))
            for a, b in slices(offsets):
                row, pos, h = _hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ks)
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_k").take(take), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64))], ["_id", "_k", "_pos", "_gram"])

    return run


def slack_of(size: int) -> int:
    """How far neighbouring diagonals of a template of so many words may be apart: in a shorter one they would be occurrences of their own."""
    return min(SLACK, size - 1)


def align(words: list[bytes], template: list[bytes]) -> tuple[int, int, int, int]:
    """First word, word behind the last, number of words found in order and of whole k-grams, of the best alignment around the longest common run.

    Runs are taken to it on either side as long as their diagonals are neighbours and the whole stays within LONGEST times the template and SLACK words.
    """
    blocks = [b for b in difflib.SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0, 0, 0, 0
    most, slack, k = int(LONGEST * len(template)) + SLACK, slack_of(len(template)), gram_of(len(template))
    i = j = max(range(len(blocks)), key=lambda k: (blocks[k].size, -k))
    near = lambda p, q: abs(blocks[p].a - blocks[p].b - blocks[q].a + blocks[q].b) <= slack
    span = lambda p, q: blocks[q].a + blocks[q].size - blocks[p].a
    while True:
        more = [(span(p, q), p, q) for p, q, u, v in ((i - 1, j, i - 1, i), (i, j + 1, j, j + 1)) if p >= 0 and q < len(blocks) and near(u, v) and span(p, q) <= most]
        if not more:
            mine = blocks[i : j + 1]
            return mine[0].a, mine[-1].a + mine[-1].size, sum(b.size for b in mine), sum(max(0, b.size - k + 1) for b in mine)
        _, i, j = min(more)


def occurrences(words: list[bytes], template: list[bytes], least: float = MIN_WORDS) -> list[tuple[int, int, int]]:
    """All occurrences: the best alignment, and those in what is left before and behind it."""
    need = int(np.ceil(least * len(template)))
    grams = max(1, MIN_VOTES * (len(template) - gram_of(len(template)) + 1))
    todo, out = [(0, len(words))], []
    while todo:
        a, b = todo.pop()
        if b - a < need:
            continue
        x, y, n, votes = align(words[a:b], template)
        if n >= need and votes >= grams:
            out.append((a + x, a + y, n))
        if n:
            todo += [(a, a + x), (a + y, b)]
    return sorted(out)


def _found(words: list[bytes], template: list[bytes], groups: list[tuple[int, int]], least: float) -> list[tuple[int, int, int]]:
    """Occurrences around groups of diagonals (lowest, highest), each once: windows that meet are searched as one, up to four templates long, and so far into each other that none is cut."""
    reach = len(template) // 2 + SLACK
    windows: list[list[int]] = []
    for low, high in sorted(groups):
        a, b = max(0, low - reach), min(len(words), high + len(template) + reach)
        if windows and a <= windows[-1][1] and b - windows[-1][0] <= 4 * len(template) + 4 * SLACK:
            windows[-1][1] = max(b, windows[-1][1])
        else:
            windows.append([a, b])
    found = {(a + x, a + y, n) for a, b in windows for x, y, n in occurrences(words[a:b], template, least)}
    kept: list[tuple[int, int, int]] = []
    for x, y, n in sorted(found, key=lambda o: (-o[2], o[1] - o[0], o[0])):
        if all(y <= p or q <= x for p, q, _ in kept):
            kept.append((x, y, n))
    return sorted(kept)


def _verify(templates: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: _words(v) for k, v in templates.items()}
        for batch in batches:
            out: list[tuple] = []
            take: list[int] = []
            for i, (text, spans) in enumerate(zip(batch.column("_t").to_pylist(), batch.column("_spans").to_pylist())):
                words = _words(text)
                by_template: dict[str, list[tuple[int, int]]] = {}
                for s in spans:
                    by_template.setdefault(s["_template"], []).append((s["_low"], s["_high"]))
                for name, groups in by_template.items():
                    for x, y, n in _found(words, known[name], groups, least):
                        out.append((name, SPDX.get(name), x, y, n, n / len(known[name])))
                        take.append(i)
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())))],
                ["doc_id", "license", "spdx_id", "start_word", "end_word", "matched", "coverage"],
            )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """One row for each verified occurrence: doc_id, license, spdx_id, start_word, end_word (behind the last), matched, coverage."""
    templates = TEMPLATES if templates is None else templates
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_k"), F.col(text_col).alias("_t"))
    id_type = texts.schema["_id"].dataType.simpleString()
    at, ks = positions(docs.sparkSession, templates, gram)
    grams = arrow_map(texts, _grams(ks), f"_id {id_type}, _k bigint, _pos int, _gram bigint")
    size = 64 * sum(len(t.split()) for t in templates.values())
    # A text is told by its id and a hash together.
    key = ["_id", "_k", "_template", "_size", "_grams"]
    hits = join_checked(grams, at, "_gram", "inner", size).select(*key, "_pos", (F.col("_pos") - F.col("_at")).alias("_diagonal"))
    votes = hits.groupBy(*key, "_diagonal").agg(F.countDistinct("_pos").alias("_votes"))
    w = Window.partitionBy("_id", "_k", "_template").orderBy("_diagonal")
    # Of a template as short as SLACK, neighbours would be occurrences of their own.
    apart = F.col("_diagonal") - F.lag("_diagonal").over(w) > F.least(F.lit(SLACK), F.col("_size") - 1)  # as slack_of() says
    votes = votes.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("_chain", F.sum("_new").over(w))
    chain = Window.partitionBy("_id", "_k", "_template", "_chain")
    # A chain is cut at multiples of the template's length, so that no group grows with the text.
    votes = votes.withColumn("_part", F.floor((F.col("_diagonal") - F.min("_diagonal").over(chain)) / F.col("_size")))
    groups = votes.groupBy(*key, "_chain", "_part").agg(F.sum("_votes").alias("_votes"), F.min("_diagonal").alias("_low"), F.max("_diagonal").alias("_high"))
    # An occurrence that such a cut goes through has half of its votes on one side at least.
    groups = groups.where(F.col("_votes") >= MIN_VOTES / 2 * F.col("_grams"))
    found = cut(groups.groupBy(F.col("_id").alias("_fid"), F.col("_k").alias("_fk")).agg(F.sort_array(F.collect_list(F.struct("_template", "_low", "_high"))).alias("_spans")))
    named = join_checked(texts, found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_k") == F.col("_fk")), "inner", size_of(found))
    return arrow_map(named.select("_id", "_t", "_spans"), _verify(templates, MIN_WORDS), f"doc_id {id_type}, license string, spdx_id string, start_word int, end_word int, matched int, coverage double")

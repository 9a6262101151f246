"""Licence scan: TF-IDF cosine of licence passages to templates, then inheritance from directories.

A passage is a window of as many words as a template has, at any place of a text (at its end, what is left of
it, if that is half or more). A text's licence is that of its best window from a cosine of ``threshold`` on. Document frequencies of the templates' words
are counted over all documents; words outside the templates weigh as much as those of the templates on average. A file
without a licence of its own takes that of the nearest directory above it that holds a licence
file: one named so, or one of which half the words or more are licence passages.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm.shared import cut, join_hot
from riskgraph.llm.text import chunks, word_hashes

_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."

# Public licence names, their texts and the wording of their usual notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", _GNU.format("GNU General Public License", 2, "GNU General Public License")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", _GNU.format("GNU General Public License", 3, "GNU General Public License")),
    ("LGPL-2.1", _GNU.format("GNU Lesser General Public License", "2.1", "GNU Lesser General Public License")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", _GNU.format("GNU Lesser General Public License", 3, "GNU Lesser General Public License")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", _GNU.format("GNU Affero General Public License", 3, "GNU Affero General Public License")),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("BSD-2-Clause", f"{_BSD_OPENING} {_BSD_END}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_THIRD} {_BSD_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES))
NEGATIONS = ("not", "never", "no")  # in a window or up to five words before it, in the sentence of its first word, they deny the licence, if the template has none
SPELLED = {"agpl": "affero", "bsl": "boost", "by": "attribution", "cc": "creative", "gpl": "gnu", "lgpl": "lesser", "mpl": "mozilla", "nc": "noncommercial", "sa": "sharealike"}  # parts of names as notices spell them
SHORT = 20  # words of a template that is a notice and not a licence's text

FILE = re.compile(r"(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$", re.I)
TOKEN = re.compile(r"(?:[0-9a-z_]|[^\x00-\x7f])+")
END = re.compile(r"[.!?][\"')\]]*\s+(?![0-9])|\n\s*\n")


def words(text: str) -> list[str]:
    """The words that ``word_hashes`` sees."""
    return TOKEN.findall(text.lower())


def demands(name: str, tokens: list[str]) -> tuple[list[set[str]], set[str]]:
    """What a window must have of the licence's name, as far as the template has it: of each word one form, and the numbers, if the window states any.

    Of a licence's text only the numbers, and those only where it states a version.
    """
    parts = words(name)
    numbers = {w for w in parts if w.isdigit() and w in tokens} - {"0"}
    if len(tokens) > SHORT:
        return [], numbers if "version" in tokens else set()
    forms = [{w, SPELLED.get(w, w)} for w in ("spdx", "identifier", *parts) if not w.isdigit()]
    return [f for f in forms if f & set(tokens)], numbers


VOCABULARY = tuple(sorted({w for _, t in TEMPLATES for w in words(t)} | set(NEGATIONS)))
_hashes = word_hashes([" ".join(VOCABULARY)])[0]
_order = np.argsort(_hashes)
_sorted = _hashes[_order]


def _known(h: np.ndarray) -> np.ndarray:
    """Places in VOCABULARY of hashed words; its length for words outside."""
    at = np.minimum(np.searchsorted(_sorted, h), len(_sorted) - 1)
    return np.where(_sorted[at] == h, _order[at], len(VOCABULARY))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, list[int]]:
    """Rows of ``docs``, and in how many of them each word of VOCABULARY occurs. Each task sums its rows first; only as many numbers come to the driver."""
    size = len(VOCABULARY) + 1

    def run(batches):
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, texts in chunks([None] * len(batch), batch.column(0).to_pylist()):
                h, counts = word_hashes(texts)
                pair = np.unique(np.repeat(np.arange(len(texts)), counts) * size + _known(h))
                total += np.bincount(pair % size, minlength=size)
        total[-1] = n
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(size), pa.int32()), "n": pa.array(total, pa.int64())})

    counted = dict(docs.select(text).mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n")).collect())
    return counted.get(size - 1, 0), [counted.get(i, 0) for i in range(size - 1)]


class Matcher:
    """Cosines of windows of words to the templates: counts of words times smoothed idf, ln((1 + n) / (1 + df)) + 1."""

    def __init__(self, n: int, df: list[int], threshold: float):
        idf = [math.log((1 + n) / (1 + d)) + 1 for d in df]
        self.idf = np.array([*idf, sum(idf) / len(idf)])
        self.threshold = threshold
        place = {w: i for i, w in enumerate(VOCABULARY)}
        self.templates = []
        for name, text in TEMPLATES:
            tokens = words(text)
            vector = np.zeros(len(self.idf))
            for w, c in Counter(tokens).items():
                vector[place[w]] = c * self.idf[place[w]]
            vector /= np.linalg.norm(vector)
            self.templates.append((name, len(tokens), vector, vector * self.idf, not any(w in NEGATIONS for w in tokens)))
        self.demands = [demands(name, words(text)) for name, text in TEMPLATES]

    def cosine(self, vector: np.ndarray, at: np.ndarray, h: np.ndarray) -> float:
        """Of a window with words at ``at`` of VOCABULARY and hashes ``h``."""
        _, first, many = np.unique(h, return_index=True, return_counts=True)
        weight = many * self.idf[at[first]]
        return float(min(1.0, weight @ vector[at[first]] / np.linalg.norm(weight)))

    def fits(self, k: int, low: str, tokens: list[tuple[str, int, int]], a: int, b: int) -> bool:
        """Whether the window of the words from ``a`` to before ``b`` has the words and version that template ``k`` demands, and no negation in the sentence it begins in.

        A number that follows "version" or "v" within three words behind the window is taken for the window's.
        """
        names, numbers = self.demands[k]
        own = [w for w, _, _ in tokens[a:b]]
        behind = [w for (w, _, _), (before, _, _) in zip(tokens[b : b + 3], tokens[b - 1 :]) if before in ("version", "v")]
        stated = {w for w in own + behind if w.isdigit() and len(w) <= 2}
        if not all(f & set(own) for f in names) or (stated and not numbers <= stated):
            return False
        if self.templates[k][4]:
            for j in range(max(0, a - 5), b):
                if tokens[j][0] in NEGATIONS and not END.search(low, tokens[min(a, j)][2], tokens[max(a, j)][1] + 1):
                    return False
        return True

    def windows(self, texts: list[str]):
        """(text, cosine, template, first word, words) of all windows that reach the threshold, and each text's number of words.

        A window's cosine is at most its product with the template over the root of the sum of its words' squared weights, each
        occurrence counted for itself; both are differences of running sums, and only windows whose bound reaches the threshold are looked at.
        """
        h, counts = word_hashes(texts)
        at = _known(h)
        ends = np.repeat(np.cumsum(counts), counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        squares = np.concatenate([[0.0], np.cumsum(self.idf[at] ** 2)])
        starts = np.cumsum(counts) - counts
        read: dict[int, tuple] = {}  # lower-cased texts with their words, of those that have a window
        begin = np.flatnonzero(at < len(VOCABULARY))
        out = []
        for k, (_, size, vector, gain, _) in enumerate(self.templates):
            sums = np.concatenate([[0.0], np.cumsum(gain[at])])
            stop = np.minimum(begin + size, ends[begin])
            reach = (sums[stop] - sums[begin]) >= (self.threshold - 1e-9) * np.sqrt(squares[stop] - squares[begin])
            reach &= 2 * (stop - begin) >= size
            for a, b in zip(begin[reach].tolist(), stop[reach].tolist()):
                c = self.cosine(vector, at[a:b], h[a:b])
                if c < self.threshold:
                    continue
                i = int(owner[a])
                if i not in read:
                    low = texts[i].lower()
                    read[i] = low, [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(low)]
                if self.fits(k, *read[i], a - int(starts[i]), b - int(starts[i])):
                    out.append((i, c, k, a, b - a))
        return out, counts

    def scan(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """Each text's licence, its cosine, and the share of the text's words in licence passages, the best of those that overlap.

        Of equal cosines the first template's and then the first window counts. A text without a licence has cosine 0.
        """
        found, counts = self.windows(texts)
        best: dict[int, tuple] = {}
        taken: dict[int, list] = {}
        for owner, c, k, a, size in sorted(found, key=lambda w: (w[0], -w[1], w[2], w[3])):
            best.setdefault(owner, (TEMPLATES[k][0], c))
            spans = taken.setdefault(owner, [])
            if all(a + size <= x or y <= a for x, y in spans):
                spans.append((a, a + size))
        covered = {i: sum(y - x for x, y in spans) / max(1, int(counts[i])) for i, spans in taken.items()}
        return [(*best[i], covered[i]) if i in best else (None, 0.0, 0.0) for i in range(len(texts))]


def scan(docs: DataFrame, text: str = "text", path: str = "path", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.6) -> DataFrame:
    """``keep``, ``path``, ``own_license``, ``cosine`` and ``license_file`` of every row's whole text: two passes over the texts, which don't move.

    Null and empty texts have no licence; repeated rows stay; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    n, df = document_frequencies(docs, text)
    chosen = docs.select(F.col(text).alias("__text"), F.col(path).alias("__path"), *keep)
    names = ["path", *chosen.columns[2:], "own_license", "cosine", "license_file"]

    def run(batches):
        matcher = Matcher(n, df, threshold)
        for batch in batches:
            rows = [r for _, texts in chunks([None] * len(batch), batch.column(0).to_pylist()) for r in matcher.scan(texts)]
            named = [bool(p and FILE.search(p)) for p in batch.column(1).to_pylist()]
            made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[0] is not None and (f or r[2] >= 0.5) for r, f in zip(rows, named)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names)

    fields = [T.StructField("path", T.StringType()), *chosen.schema.fields[2:], T.StructField("own_license", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("license_file", T.BooleanType())]
    return chosen.withColumn("__path", F.col("__path").cast("string")).mapInArrow(run, T.StructType(fields))


def directory(path) -> F.Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, "/?[^/]*$", ""), "/+$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``license``, ``origin`` (own, inherited, none) and ``license_dir``.

    A directory's licence is that of its licence files with the highest cosine, of equals the first by path.
    Directories are made distinct before their ancestors are exploded, so a directory with
    many files costs one row; files then meet their directory by ``join_hot``.
    A null path, or no licence above, gives none.
    """
    scanned = cut(scanned)  # three readers, one scan
    held = scanned.where("license_file AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("license_dir"))
    held = held.agg(F.min_by("own_license", F.struct(-F.col("cosine"), F.col("path"), F.col("own_license"))).alias("dir_license"))
    below = cut(scanned.where("own_license IS NULL AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("__dir")).agg(F.count("*").alias("__many")))
    parts = F.split("__dir", "/")
    above = below.select("__dir", F.explode(F.when(F.col("__dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"), parts.alias("parts"))
    above = above.select("__dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("license_dir"))
    counted = held.join(above.groupBy("license_dir").agg(F.count("*").alias("__n")), "license_dir")  # how many directories lie below each
    found = join_hot(above, cut(counted), "license_dir", "__n").where("dir_license IS NOT NULL")
    nearest = found.groupBy("__dir").agg(F.max_by(F.struct("license_dir", "dir_license"), "depth").alias("__from"))
    files = scanned.withColumn("__dir", F.when(F.col("own_license").isNull(), directory(F.col("path"))))
    met = join_hot(files, cut(below.join(nearest, "__dir", "left")), "__dir", "__many")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("__from").isNotNull(), "inherited").otherwise("none")
    return met.select(*scanned.columns, F.coalesce("own_license", "__from.dir_license").alias("license"), origin.alias("origin"), F.col("__from.license_dir").alias("license_dir"))

"""License scans: sparse TF-IDF cosine of text windows to templates, then inheritance along directories.

A window is a run of as many consecutive terms as a template has (a shorter text: all of it), wherever the lines
break. Weights are term counts times the inverse document frequency among the templates; terms that no template has
weigh as much as the rarest, so foreign words lower a score. A window can only reach the threshold if it holds one of
its template's strong terms (those without which the rest of the template weighs too little), and if the bound holds
that its terms would give without repetitions; other windows are passed over without losing a match. Whole texts are
scanned. An SPDX line that names a known license counts as a full match.

A text with a match has its own license: that of the best score, the longer template among equals. A text is a license
file if a license's opening words stand near its start, or if matched windows hold at least `file_share` of its terms:
it also licenses its directory. Files without their own license take that of the nearest directory above them that
has one: distinct directories are exploded to their ancestors, joined to licensed directories and reduced to the
deepest; files join the result by directory.

Null or empty texts have no license of their own; null paths inherit nothing; several license files of a directory:
best score, then smallest path. Repeated rows get equal results; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: usual statements of each license
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
# fixed values: the opening words of license files
HEADS = (
    ("Apache-2.0", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# fixed values: whole short licenses
BODIES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
TEMPLATES = STATEMENTS + HEADS + BODIES
NAMES = tuple(dict.fromkeys(name for name, _ in TEMPLATES))
#: fixed values: a license whose text holds that of another
CONTAINS = {"BSD-3-Clause": "BSD-2-Clause"}
#: fixed values: of licenses with nearly the same wording, terms that a window must have (one of each group) and may not have
MARKS = {
    "GPL-2.0": ((("2", "2.0", "v2"),), ("lesser", "affero")),
    "GPL-3.0": ((("3", "3.0", "v3"),), ("lesser", "affero")),
    "LGPL-2.1": ((("lesser",), ("2.1", "v2.1")), ()),
    "LGPL-3.0": ((("lesser",), ("3", "3.0", "v3")), ()),
    "AGPL-3.0": ((("affero",), ("3", "3.0", "v3")), ()),
}
#: fixed values: words that any English text has
COMMON = frozenset("a an and any as at be by can for from if in into is it its may no not of on or other that the these this those to under use was were with without you your".split())
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SPDX = re.compile(r"spdx-license-identifier:\s*([a-z0-9][a-z0-9.+-]*)")
HEAD_WITHIN = 60  # terms before the opening words of a license file: its name, a date, a holder
CHUNK = 1 << 15  # terms of a text that are weighed at once


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = 0.75, heads=HEADS):
        self.threshold = threshold
        counts = [Counter(TERM.findall(t.lower())) for _, t in templates]
        df = Counter(t for c in counts for t in c)
        n = len(templates)
        self.idf = {t: 1 + math.log((1 + n) / (1 + d)) for t, d in df.items()}
        self.rare = 1 + math.log(1 + n)
        self.names = [name for name, _ in templates]
        self.known = {x.lower(): x for x in self.names}
        self.sizes = [sum(c.values()) for c in counts]
        self.is_head = [t in heads for t in templates]
        marks = {t for must, may_not in MARKS.values() for t in [*may_not, *(x for group in must for x in group)]}
        for t in sorted(marks - self.idf.keys()):
            self.idf[t] = self.rare
        self.at = {t: i + 1 for i, t in enumerate(self.idf)}  # 0: a term that no template has
        of = [MARKS.get(x, ((), ())) for x in self.names]
        self.marks = [[{self.at[t] for t in group} for group in must] for must, _ in of]
        self.unmarks = [{self.at[t] for t in may_not} for _, may_not in of]
        self.weights = np.array([self.rare, *self.idf.values()])
        self.share = np.zeros((n, len(self.at) + 1))  # what one occurrence of a term adds to the product with a template
        strong: dict[str, None] = {}
        self.needs = np.zeros((n, len(self.at) + 1), bool)
        for i, c in enumerate(counts):
            v = {t: k * self.idf[t] for t, k in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for t in v:
                self.share[i, self.at[t]] = self.idf[t] * v[t] / norm
            # common and short terms, as far as their weight alone can't reach the threshold, are weak, the others
            # strong: those occur in any text, so few windows without a match are weighed
            weight = 0.0
            for t in sorted(v, key=lambda t: (t not in COMMON, len(t), v[t], t)):
                weight += (v[t] / norm) ** 2
                if math.sqrt(weight) >= threshold:
                    strong[t] = None
                    self.needs[i, self.at[t]] = True
        self.strong = set(strong)
        self.find_strong = re.compile("|".join(sorted((rf"\b{re.escape(t)}\b" for t in self.strong), key=len, reverse=True))).search

    def score(self, terms: list[int], i: int) -> float:
        """The cosine of a window of term numbers to template i, 0 without its marks; term 0 stands for different foreign terms each."""
        c = Counter(terms)
        if self.unmarks[i] & c.keys() or not all(group & c.keys() for group in self.marks[i]):
            return 0.0
        square = c.pop(0, 0) * self.rare**2 + sum((k * self.weights[t]) ** 2 for t, k in c.items())
        return sum(k * self.share[i, t] for t, k in c.items()) / math.sqrt(square) if square else 0.0

    def windows(self, ids: np.ndarray):
        """(template, start, end, score) of every window that reaches the threshold."""
        n = len(ids)
        hits = self.needs[:, ids].any(axis=1)
        square = np.concatenate([[0.0], np.cumsum(self.weights[ids] ** 2)])
        for i in np.flatnonzero(hits).tolist():
            size = min(self.sizes[i], n)
            own = np.concatenate([[0.0], np.cumsum(self.share[i, ids])])
            need = np.concatenate([[0], np.cumsum(self.needs[i, ids])])
            dot, low, has = own[size:] - own[:-size], square[size:] - square[:-size], need[size:] > need[:-size]
            # repetitions only add to a window's length, so this bound is never below its cosine
            for a in np.flatnonzero(has & (dot >= (self.threshold - 1e-9) * np.sqrt(low))).tolist():
                s = self.score(ids[a : a + size].tolist(), i)
                if s >= self.threshold:
                    yield i, a, a + size, s

    def scan(self, text: str | None) -> tuple[str | None, int | None, bool, float]:
        """(license, score in thousandths, whether it opens like a license file, share of the text's terms in matched windows)."""
        low = (text or "").lower()
        tag = next((self.known[y] for x in SPDX.finditer(low) for y in [re.sub(r"(-only|-or-later|\+)$", "", x[1].rstrip("."))] if y in self.known), None)
        if not tag and not self.find_strong(low):
            return None, None, False, 0.0
        ids = np.array([self.at.get(t, 0) for t in TERM.findall(low)], np.int64)
        covered = np.zeros(len(ids), bool)
        found: dict[str, tuple[int, int]] = {tag: (1000, 0)} if tag else {}
        opens = False
        reach = max(self.sizes)
        for at in range(0, max(len(ids) - reach, 0) + 1, CHUNK):
            for i, a, b, s in self.windows(ids[at : at + CHUNK + reach]):
                covered[at + a : at + b] = True
                opens = opens or (self.is_head[i] and at + a <= HEAD_WITHIN)
                found[self.names[i]] = max(found.get(self.names[i], (0, 0)), (round(1000 * s), self.sizes[i]))
        if not found:
            return None, None, False, 0.0
        for more, less in CONTAINS.items():
            if more in found and less in found and (found[more] >= found[less] or found[less][1] < max(k for n, k in zip(self.names, self.sizes, strict=True) if n == less)):
                found[more] = max(found.pop(less), found[more])
        best = max(found, key=lambda name: (found[name], -self.names.index(name)))
        return best, found[best][0], opens, float(covered.sum()) / max(len(ids), 1)


@lru_cache(2)
def scanner(threshold: float) -> Scanner:
    return Scanner(threshold=threshold)


def own_licenses(df: DataFrame, threshold: float = 0.75, file_share: float = 0.3, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, own_license, score, is_license_file) of every row."""

    def run(batches):
        s = scanner(threshold)
        for b in batches:
            rows = [s.scan(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] or (r[0] is not None and r[3] >= file_share) for r in rows], pa.bool_())], names=[id_col, path_col, "own_license", "score", "is_license_file"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, path_col, text_col).mapInArrow(run, f"{id_col} {kind}, {path_col} string, own_license string, score int, is_license_file boolean")


def directory(path):
    """Everything before the last slash; a path without one lies in the root, ''."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(own: DataFrame, path_col: str = "path") -> DataFrame:
    """own with license (its own, else the nearest licensed directory's) and inherited_from (null: its own or none)."""
    rows = own.withColumn("__dir", directory(F.col(path_col)))
    licensed = rows.filter("is_license_file").groupBy("__dir").agg(F.min_by("own_license", F.struct(-F.col("score"), F.col(path_col))).alias("__license")).withColumnRenamed("__dir", "__above")
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = rows.select("__dir").filter("__dir is not null").distinct().withColumn("__above", F.explode(F.array_distinct(above)))
    near = dirs.join(licensed, "__above").groupBy("__dir").agg(F.max_by(F.struct("__license", "__above"), F.length("__above")).alias("__near"))
    j = rows.join(near.withColumnRenamed("__dir", "__of"), F.col("__dir") == F.col("__of"), "left")
    none = F.col("own_license").isNull()
    return j.select(*own.columns, F.coalesce("own_license", "__near.__license").alias("license"), F.when(none, F.col("__near.__above")).alias("inherited_from"))


def license_table(df: DataFrame, **options) -> DataFrame:
    from lithoframe.llm.common import cut

    return inherit(cut(own_licenses(df, **options)))


def document_paths(df: DataFrame) -> DataFrame:
    """The documents as a tree of files: source / language / folder of 64 / file. Null parts read 'none'."""
    part = [F.coalesce(F.col(c), F.lit("none")) for c in ("source", "lang")]
    return df.select("doc_id", F.concat_ws("/", *part, F.expr("doc_id div 64").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")

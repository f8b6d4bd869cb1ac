"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's candidates
are its lines that hold a cue word, the windows of up to WINDOWS lines around them (a wrapped notice) and the whole text, whatever its
length. Each is a sparse vector of term counts weighted by the templates' inverse document frequencies; the best cosine to
a template decides. The tag lines of the templates' identifiers, plain, -only and -or-later, are templates too, weighted by
the others' frequencies, so an SPDX tag is scored like any notice; a tag whose first identifier no template has stands for
it where no cosine is above that tag line's own, score 1. A file that is a licence file (by name or by the whole text's cosine) licenses its directory; a file
without a licence of its own takes that of the nearest ancestor directory that has one. Directories, not files, are
joined with their ancestors, so a directory with a third of all files costs one row for each level above it.

Defined results: a null or empty text has no licence of its own; a null path has no directory and inherits nothing; of
equal cosines the first template by name wins, of several licence files in one directory the best cosine, then the
last name; repeated rows, or a directory of nothing else, are judged alike; an empty table gives an empty result; extra columns are
ignored. Texts are read whole, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import stored

# Full texts, notices, usual headers and titles by SPDX identifier.
_MIT = "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0", "This project is licensed under the Apache License 2.0 - see the LICENSE file for details", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "BSD-2-Clause": (_BSD.format("").strip() + " " + _DISCLAIMER, "Licensed under the BSD 2-Clause License", "This project is licensed under the BSD 2-Clause License - see the LICENSE file for details"),
    "BSD-3-Clause": (_BSD.format(_THIRD) + " " + _DISCLAIMER, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License", "This project is licensed under the BSD 3-Clause License - see the LICENSE file for details"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0"),
    "GPL-2.0": ("This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.", "This work is licensed under the GNU General Public License, version 2", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("This program is free software: you can redistribute it under the terms of the GNU General Public License version 3.", "This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This project is licensed under the GNU General Public License v3.0 - see the LICENSE file for details"),
    "LGPL-2.1": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "ISC": ("ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC, "Licensed under the ISC License"),
    "MIT": (_MIT, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License - see the LICENSE file for details"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
CUES = (b"license", b"licence", b"licensed", b"spdx", b"permission is hereby", b"redistribution and use")
LIMIT, FILE_LIMIT = 0.60, 0.85
#: Lines of a window, and how many of them may stand before the line with the cue.
WINDOWS, BEFORE = (2, 3, 4, 5), 2
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([-._][^/]*)?$"
FIELDS = "path string, own_license string, own_score double, is_license_file boolean"
_SPDX = re.compile(r"SPDX-License-Identifier:[\s(]*([A-Za-z0-9][A-Za-z0-9.+-]*)", re.I)
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


class Matcher:
    def __init__(self, templates=TEMPLATES):
        rows = [(name, Counter(_TERM.findall(t.lower()))) for name, texts in sorted(templates.items()) for t in texts]
        df = Counter(term for _, c in rows for term in c)
        self.idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
        self.rare = math.log(1 + len(rows)) + 1  # of a term that no template has
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in rows]
        tags = [(name, Counter(_TERM.findall(f"spdx-license-identifier: {name}{end}".lower()))) for name in sorted(templates) for end in ("", "-only", "-or-later")]
        rows += tags  # they count in no document frequency
        self.names += [name for name, _ in tags]
        for k, (_, c) in enumerate(rows):
            w = {t: n * self.idf.get(t, self.rare) for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                self.index.setdefault(t, []).append((k, x / norm))

    def best(self, text: str) -> tuple[float, str]:
        c = Counter(_TERM.findall(text.lower()))
        dots, norm = [0.0] * len(self.names), 0.0
        for t, n in c.items():
            w = n * self.idf.get(t, self.rare)
            norm += w * w
            for k, x in self.index.get(t, ()):
                dots[k] += w * x
        k = max(range(len(dots)), key=lambda i: (dots[i], -i))
        return (dots[k] / math.sqrt(norm), self.names[k]) if norm else (0.0, self.names[0])

    def strange(self, tag: str) -> str | None:
        """A tag's identifier without -only, -or-later and +, if no template has it."""
        plain = re.sub(r"(?i)(-only|-or-later|\+)$", "", tag).rstrip(".-")
        return None if any(n.lower() == plain.lower() for n in self.names) else plain

    def own(self, text: str | None) -> tuple[str | None, float, bool]:
        """Licence, cosine, and whether the whole text is one."""
        data = (text or "").encode("utf-8", "surrogatepass")
        low = data.lower()
        if not any(c in low for c in CUES):
            return None, 0.0, False
        found = (0.0, "")
        lines = data.split(b"\n")
        spans = {}  # ordered, each once
        for i, line in enumerate(lines):
            if any(c in line.lower() for c in CUES):
                spans[i, i + 1] = None
                spans |= {(at, at + n): None for n in WINDOWS for at in range(max(i - BEFORE, 0), i + 1) if i < at + n <= len(lines)}
        for at, end in spans:
            found = max(found, self.best(b" ".join(lines[at:end]).decode("utf-8", "replace")), key=lambda x: x[0])
        whole = self.best(text)
        is_file = whole[0] >= FILE_LIMIT
        found = max(found, whole, key=lambda x: x[0])
        tag = _SPDX.search(text)
        if tag and found[0] < 1 - 1e-9 and (name := self.strange(tag[1])):
            return name, 1.0, is_file
        return (found[1], found[0], is_file) if found[0] >= LIMIT or is_file else (None, found[0], False)


def scanned(files: DataFrame, key: str = "path") -> DataFrame:
    """key, path, own_license, own_score, is_license_file for every row of files(path, text)."""
    kind = files.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher()
        for b in batches:
            out = [m.own(t) for t in b.column(2).to_pylist()]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["key", "path", "own_license", "own_score", "whole"])

    out = files.select(F.col(key).alias("key"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"key {kind}, path string, own_license string, own_score double, whole boolean")
    return out.withColumn("is_license_file", F.col("own_license").isNotNull() & (F.col("whole") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))).drop("whole")


def _dir(path: str) -> str:
    return f"CASE WHEN instr({path}, '/') > 0 THEN regexp_extract({path}, '^(.*)/', 1) WHEN {path} IS NOT NULL THEN '' END"


def inherited(files: DataFrame, key: str = "path") -> DataFrame:
    """key, path, own_license, own_score, is_license_file, license, license_dir (where it comes from; null if its own)."""
    own = stored(scanned(files, key).withColumn("dir", F.expr(_dir("path"))))
    licensed = own.where("is_license_file AND dir IS NOT NULL").groupBy("dir").agg(F.max_by("own_license", F.struct("own_score", F.col("own_license"))).alias("dir_license"))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), i -> CASE WHEN i = 0 THEN '' ELSE array_join(slice(split(dir, '/'), 1, i), '/') END)")).alias("at")).distinct()
    near = above.join(licensed.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by(F.struct("at", "dir_license"), F.length("at")).alias("from"))
    out = own.join(near, "dir", "left")
    return out.select("key", "path", "own_license", F.round("own_score", 6).alias("own_score"), "is_license_file", F.coalesce("own_license", F.col("from.dir_license")).alias("license"), F.when(F.col("own_license").isNull(), F.col("from.at")).alias("license_dir"))

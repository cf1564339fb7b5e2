"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path joins.

What is compared are segments: runs of adjacent lines that speak of licences (a cue, or mostly words of the templates;
comment marks are taken off and blank lines passed over), single lines with a cue, and the whole text of a file named
as a licence. Tokens are weighted by term frequency and by an inverse document frequency over templates and the
corpus's segments; the cosine of a segment to a template is a join on tokens followed by a sum. Equal segments are
compared once. A file's own licence is that of its best segment. A file that mostly consists of matched segments, or is
named as a licence and has one, stands for its directory. Files without a licence of their own take that of the nearest
ancestor directory: directories, not files, are resolved by joins on their ancestors' paths, so a directory of a third
of all files is one row there.

Tables made of the templates are left to Spark's own size check. Joins of files with what is said of an equal segment,
or of their directory, need no key's rows together afterwards, so adaptive execution can split a common key.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hashed_set, table

# Texts, headers and short forms in which licences are stated.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This %s is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version. This %s is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %s for more details. You should have received a copy of the GNU %s along with this %s. If not, see http://www.gnu.org/licenses/."
_GNU_KINDS = [
    ("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"),
]
_SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later",
         "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
#: Many licences begin with such a line, so it counts only where nothing else is found.
RESERVED = "proprietary"
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", f"{_GRANT}, to deal in the software without restriction"),
    ("MIT", f"MIT License. {_GRANT} (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    *[(name, _GNU % (work, kind, version, work, kind, kind, work)) for name, work, kind, version in _GNU_KINDS],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_NAMES} {_BSD_END}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (RESERVED, "All rights reserved."),
    (RESERVED, "Copyright (c). All rights reserved."),
    (RESERVED, "Copyright (c) the company. All rights reserved. Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    *[(re.sub("-(only|or-later)$", "", x), f"SPDX-License-Identifier: {x}") for x in _SPDX],
]
CUE = r"(?i)licen[sc]|copyright|spdx|all rights reserved|permission is hereby|permission to use|redistribut|public domain|\bcc by\b|\bgpl\b"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
COMMENT = r"^[\s/*#;%!|<>.-]+|[\s/*#|<>-]+$"
TOKEN = "[a-z]+(?:-[a-z]+)*|[0-9]+(?:[.][0-9]+)?"
THRESHOLD = 0.6
FILE_SHARE = 0.5
#: Share of a line's tokens that the templates must know for it to go on a run, and how many it must have.
KNOWN_SHARE, KNOWN_LEAST = 0.75, 3
_BREAK = "\ue000"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_id(token: str) -> int:
    """As ``xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest(token.encode(), seed=42)
    return h - (h >> 63 << 64)


def segments(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """path, doc_id, file_words, at, kind (run, line or file), body, n_words: what is compared of each file, in order.

    One pass over the texts, of which only those with a cue, or of files named as a licence, go on.
    """
    in_templates = hashed_set(sorted({t for _, body in templates for t in re.findall(TOKEN, body.lower())}))
    clean = F.translate(F.coalesce("text", F.lit("")), _BREAK, " ")
    named = F.coalesce("path", F.lit("")).rlike(FILE_NAME)
    rows = files.where(F.col("text").rlike(CUE) | named).select("path", "doc_id", clean.alias("text"), named.alias("named"))
    rows = rows.withColumn("lines", F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, COMMENT, "")))

    def speaks(line: Column) -> Column:
        known = lambda t: (F.size(t) >= KNOWN_LEAST) & (F.size(F.filter(t, in_templates)) >= KNOWN_SHARE * F.size(t))
        return line.rlike(CUE) | F.exists(F.array(tokens(line)), known)

    said = F.transform("lines", lambda x: F.when((x == "") | speaks(x), x).otherwise(_BREAK))
    runs = F.transform(F.filter(F.split(F.array_join(said, "\n"), _BREAK), lambda x: x.rlike(CUE)), F.trim)
    kind = lambda name, bodies: F.transform(bodies, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("body")))
    whole = F.when(F.col("named"), F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    each = F.concat(kind("run", runs), kind("line", F.filter("lines", lambda x: x.rlike(CUE))), kind("file", whole))
    rows = rows.select("path", "doc_id", F.size(tokens(F.col("text"))).alias("file_words"), F.posexplode(each).alias("at", "s"))
    rows = rows.select("path", "doc_id", "file_words", "at", "s.kind", "s.body").withColumn("tokens", tokens(F.col("body")))
    return rows.withColumns({"n_words": F.size("tokens"), "key": F.md5(F.array_join("tokens", " "))})


def matched_segments(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """path, doc_id, file_words, at, kind, n_words, license, similarity: the best template of each segment, if close enough."""
    spark = files.sparkSession
    rows = cut(segments(files, templates).drop("body"))
    # Equal segments are compared once; a token's weight in one of them is a row.
    each = cut(rows.select("key", "tokens").dropDuplicates(["key"]).select("key", F.explode("tokens").alias("token")).groupBy("key", F.xxhash64("token").alias("token")).agg(F.count("*").alias("tf")))
    counts = [Counter(re.findall(TOKEN, body.lower())) for _, body in templates]
    known = {t: token_id(t) for c in counts for t in c}
    frame = lambda data, schema: spark.createDataFrame(data or [], schema)
    # How many segments hold each token of the templates: a row a token of theirs.
    vocabulary = frame([(i,) for i in known.values()], "token long")
    seen = {r["token"]: r["n"] for r in each.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    n_segments, n = each.agg(F.count_distinct("key").alias("n")).first()["n"], len(templates)
    idf = {t: math.log((1 + 2 * n) / (1 + sum(t in c for c in counts) + n * seen.get(i, 0) / max(n_segments, 1))) + 1 for t, i in known.items()}
    vectors = [{t: (1 + math.log(tf)) * idf[t] for t, tf in c.items()} for c in counts]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    shares = frame([(known[t], k, w / norms[k]) for k, v in enumerate(vectors) for t, w in v.items()], "token long, template int, share double")
    weights = frame([(known[t], x) for t, x in idf.items()], "token long, idf double")
    w = each.join(weights, "token", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(math.log(1 + 2 * n) + 1)))
    lengths = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = w.join(shares, "token").groupBy("key", "template").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    best = dots.join(lengths, "key").withColumn("similarity", F.round(F.col("dot") / F.col("length"), 6))
    best = best.groupBy("key").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"))).alias("b")).where(F.col("b.similarity") >= threshold)
    names = F.split(F.lit("\n".join(name for name, _ in templates)), "\n")
    best = best.select("key", F.get(names, -F.col("b.t")).alias("license"), "b.similarity")
    return rows.join(best, "key").select("path", "doc_id", "file_words", "at", "kind", "n_words", "license", "similarity")


def ancestors(directory: Column) -> Column:
    """The directory itself and every one above it, the root being empty."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """Per row of files: path, doc_id, license, similarity, is_license_file, inherited_from.

    files: path, doc_id, text; other columns are ignored. license is null where neither the file nor a directory
    above it has one; inherited_from is the directory, '' for the root, null for a licence of its own. A licence
    comes before the mere reservation of rights, then the greater similarity, then the earlier segment (runs before
    lines), and there the earlier template; of several licence files in a directory the one with the greater similarity, then the lesser licence name, counts. A
    null or empty text has no licence of its own. A null path has no directory and inherits nothing. Rows that repeat
    path and doc_id share their segments. An empty files gives no rows. The private character U+E000 counts as a blank.
    """
    files = files.select("path", "doc_id", "text")
    words = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_words"))), F.lit(0))
    own = matched_segments(files, templates, threshold).groupBy("path", "doc_id").agg(
        F.max(F.struct((F.col("license") != RESERVED).alias("granted"), "similarity", (-F.col("at")).alias("a"), "license")).alias("b"), F.greatest(words("run"), words("line"), words("file")).alias("licence_words"), F.max("file_words").alias("n")
    )
    own = own.select(F.col("path").alias("__path"), F.col("doc_id").alias("__id"), "b.license", "b.similarity", (F.col("licence_words") >= file_share * F.col("n")).alias("mostly"))
    same = F.col("path").eqNullSafe(F.col("__path")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    rows = files.select("path", "doc_id").join(own, same, "left").drop("__path", "__id")
    stands = F.col("license").isNotNull() & (F.col("mostly") | F.coalesce("path", F.lit("")).rlike(FILE_NAME))
    folder = F.array_join(F.filter(F.split(F.regexp_replace("path", "[^/]*$", ""), "/"), lambda x: x != ""), "/")
    rows = cut(rows.withColumns({"is_license_file": F.coalesce(stands, F.lit(False)), "__dir": folder}))
    given = rows.where("is_license_file and __dir is not null").groupBy(F.col("__dir").alias("up")).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("g")
    ).select("up", F.col("g.license").alias("dir_license"), (-F.col("g.s")).alias("dir_similarity"))
    dirs = rows.where("license is null and __dir is not null").select("__dir").distinct()
    nearest = dirs.select("__dir", F.posexplode(ancestors(F.col("__dir"))).alias("depth", "up")).join(given, "up").groupBy("__dir").agg(
        F.max(F.struct("depth", "up", "dir_license", "dir_similarity")).alias("d")
    )
    found = rows.join(nearest, "__dir", "left")
    return found.select(
        "path", "doc_id", F.coalesce("license", "d.dir_license").alias("license"), F.coalesce("similarity", "d.dir_similarity").alias("similarity"),
        "is_license_file", F.when(F.col("license").isNull(), F.col("d.up")).alias("inherited_from"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files: source / language / thousands of the id / id."""
    parts = [F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))]
    return docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, taken as a file. Edges: see ``scan_licenses``."""
    return scan_licenses(document_files(table(spark, sf_dir, "documents")))

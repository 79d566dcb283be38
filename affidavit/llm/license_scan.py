"""Licence scans in DataFrame functions only: TF-IDF cosine to templates, then inheritance by directory.

Templates are short notices, SPDX tags, header notices and full licence texts.
What is compared with them, as sparse TF-IDF vectors, are a file's blocks: its
header (the comment lines that it opens with), every window of 1 to ``WINDOW``
consecutive lines, so that a wrapped notice is found too, and the whole text of a
licence file.  Document frequencies of the templates' tokens are counted over all
files, and a token of no template counts as one that no file holds.  A block can
reach the threshold only if it shares one of a template's heavy tokens: the
lightest ones that together stay below the threshold (by the Cauchy-Schwarz
bound) aren't enough.  Of the blocks with a heavy token, each different one is
looked at once.  Only those are weighed that hold enough different tokens of one
template, however they are weighted, and only those leave their task in whose norm the
templates' tokens have a large enough share (the same bound), so long texts don't.

A file has the licence of its best block.  A directory has the licence that most
of its licence files have.  A file without a licence of its own gets that of the
nearest directory around it that has one, by joining the ancestors of each
different directory with the directories that have one.

No text crosses the network but the candidate blocks.  Defined cases: a null or
empty text has no licence; a very long text is read where it lies, and of it only
blocks with a heavy token are made; a null path has no directory and inherits
nothing; rows that repeat a path are one file, and each row gets its result; ties
go to the licence that comes first by name; further columns pass through, but for
those named like a result, which are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, stored

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will "
    "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "{0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_SPDX = "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-3.0 AGPL-3.0 MPL-2.0 BSD-2-Clause BSD-3-Clause ISC CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
#: (licence, notice): public texts, given as they are published.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. " + _WARRANTY,
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    *[(name, f"SPDX-License-Identifier: {name}") for name in _SPDX],
]
LEAST, WINDOW = 0.8, 3
#: A line of the comment that a file opens with.
COMMENT = r"^\s*(#|//|/[*]|[*]|--|;|%|<!--)"
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$"
TOKEN = "[a-z0-9]+(?:[.][0-9]+)*"
ADDED = ("licence", "score", "licence_of", "own_licence")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, with decimal parts, in lower case."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(TOKEN), F.lit(0))


def idf(n_files: int, n_with: int) -> float:
    return math.log((1 + n_files) / (1 + n_with)) + 1


def frequencies(files: DataFrame, text: str, templates: list[tuple[str, str]]) -> tuple[int, dict[str, int]]:
    """The number of files, and of those that hold each token of the templates."""
    known = sorted({t for _, notice in templates for t in re.findall(TOKEN, notice.lower())})
    held = F.array_intersect(tokens(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.array(*[F.lit(t) for t in known]))
    counts = files.select(F.explode(F.array_append(held, F.lit(""))).alias("t")).groupBy("t").count()
    found = {r["t"]: r["count"] for r in counts.collect()}  # a row for each token of the templates
    return found.get("", 0), {t: found.get(t, 0) for t in known}


def template_vectors(n: int, df: dict[str, int], templates: list[tuple[str, str]]) -> list[tuple[int, str, dict[str, float]]]:
    out = []
    for k, (licence, notice) in enumerate(templates):
        w = {t: f * idf(n, df[t]) for t, f in Counter(re.findall(TOKEN, notice.lower())).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append((k, licence, {t: x / norm for t, x in w.items()}))
    return out


def heavy_tokens(vectors: list[tuple[int, str, dict[str, float]]], least: float) -> list[str]:
    """Tokens of which a block needs one to reach ``least`` with some template."""
    heavy: set[str] = set()
    for _, _, w in vectors:
        total = 0.0
        for t, x in sorted(w.items(), key=lambda p: (p[1], p[0])):
            total += x * x
            if total >= (least * least) * (1 - 1e-9):
                heavy.add(t)
    return sorted(heavy)


def any_of(words: list[str]) -> str:
    """A pattern for one of the words as a whole token, branched by the first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    each = "|".join(f"{re.escape(c)}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by.items()))
    return f"(?i)(?<![a-z0-9])(?:{each or '(?!)'})(?![a-z0-9])"


def enough_tokens(vectors: list[tuple[int, str, dict[str, float]]], least: float) -> list[tuple[list[str], int]]:
    """For each template its tokens, and how many different ones of them a block needs at least to reach ``least`` with it."""
    out = []
    for _, _, w in vectors:
        total, k = 0.0, 0
        for x in sorted(w.values(), reverse=True):
            if total >= least * least * (1 - 1e-9):
                break
            total, k = total + x * x, k + 1
        out.append((sorted(w), k))
    return out


def may_share(block: Column, enough: list[tuple[list[str], int]]) -> Column:
    """Whether a block holds enough different tokens of some template: a bound without weights, in built-in array functions."""
    words = lambda ts: F.array(*[F.lit(t) for t in ts])
    every = sorted({t for ts, _ in enough for t in ts})

    def of(known: Column) -> Column:
        found = F.lit(False)
        for ts, k in enough:
            found = found | (F.size(F.array_intersect(known, words(ts))) >= k)
        return found

    return bind(F.array_intersect(tokens(block), words(every)), of)


def may_reach(block: Column, n: int, df: dict[str, int], least: float) -> Column:
    """Whether the templates' tokens have enough of a block's norm for any template to reach ``least`` (by Cauchy-Schwarz)."""
    weights = F.create_map(*[F.lit(x) for t, k in sorted(df.items()) for x in (t, idf(n, k))])
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("tf"), F.lit(0.0).alias("known"), F.lit(0.0).alias("all"))

    def closed(acc: Column) -> tuple[Column, Column]:
        """The sums once the run of equal tokens has ended."""
        own = F.element_at(weights, acc["t"]) * acc["tf"]
        return acc["known"] + F.coalesce(own * own, F.lit(0.0)), acc["all"] + F.coalesce(own * own, F.pow(acc["tf"] * idf(n, 0), F.lit(2.0)))

    def step(acc: Column, t: Column) -> Column:
        known, every = closed(acc)
        same = F.struct(acc["t"].alias("t"), (acc["tf"] + 1).alias("tf"), acc["known"].alias("known"), acc["all"].alias("all"))
        return F.when(acc["t"] == t, same).otherwise(F.struct(t.alias("t"), F.lit(1).alias("tf"), known.alias("known"), every.alias("all")))

    sums = F.aggregate(F.sort_array(tokens(block)), zero, step, lambda acc: F.struct(*(x.alias(c) for x, c in zip(closed(acc), ("known", "all"), strict=True))))
    return bind(sums, lambda s: s["known"] >= s["all"] * (least * least * (1 - 1e-9)))


def blocks(text: Column, whole: Column, needed: Column, good: Callable[[Column], Column]) -> Column:
    """Different blocks of a text that hold a heavy token and are ``good``; the whole text is one where ``whole``."""
    lines = F.split(text, "\n")

    def of(ls: Column) -> Column:
        def windows(marks: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.array_contains(F.slice(marks, i, WINDOW), F.lit(True)))
            return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda n: F.array_join(F.slice(ls, i, n), "\n"))))

        other = F.array_position(F.transform(ls, lambda x: ~F.rlike(x, F.lit(COMMENT))), F.lit(True))
        header = F.array_join(F.slice(ls, F.lit(1), F.when(other > 0, other - 1).otherwise(F.size(ls)).cast("int")), "\n")
        found = bind(F.transform(ls, lambda x: F.rlike(x, needed)), windows)
        every = F.concat(found, F.array(header), F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
        return F.filter(F.array_distinct(F.filter(every, lambda s: F.rlike(s, needed))), good)

    return bind(lines, of)


def best_lines(lines: DataFrame, n: int, df: dict[str, int], vectors: list, least: float) -> DataFrame:
    """(line, licence, score) of the different blocks that reach ``least`` with a template."""
    spark = lines.sparkSession
    weights = F.broadcast(spark.createDataFrame([(t, idf(n, k)) for t, k in df.items()], "token string, idf double"))
    entries = [(k, name, t, x) for k, name, w in vectors for t, x in w.items()]
    table = F.broadcast(spark.createDataFrame(entries, "template int, licence string, token string, q double"))
    tf = (
        lines.select("line", F.explode(tokens(F.col("line"))).alias("token"))
        .groupBy("line", "token").agg(F.count("*").alias("tf"))
        .join(weights, "token", "left")
        .select("line", "token", (F.col("tf") * F.coalesce("idf", F.lit(idf(n, 0)))).alias("w"))
    )
    norms = tf.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(table, "token").groupBy("line", "template", "licence").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 6)
    return (
        dots.join(norms, "line")
        .select("line", "licence", score.alias("score"))
        .where(F.col("score") >= least)
        .groupBy("line")
        .agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("b"))
        .select("line", "b.licence", "b.score")
    )


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_extract(path, "^(?s)(.*)/[^/]*$", 1)


def license_scan(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    licence_file: str = LICENCE_FILE,
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """``files`` with own_licence and score (null without one), licence, and licence_of: the directory it came from."""
    tag = uuid.uuid4().hex[:8]
    n, df = frequencies(files, text, templates)
    vectors = template_vectors(n, df, templates)
    needed = F.lit(any_of(heavy_tokens(vectors, least)))
    column = F.col(f"`{text}`")
    enough = enough_tokens(vectors, least)
    good = lambda block: F.when(may_share(block, enough), may_reach(block, n, df, least)).otherwise(False)
    whole = F.coalesce(F.rlike(F.col(f"`{path}`"), F.lit(licence_file)), F.lit(False))
    holding = files.where(F.rlike(column, needed)).select(F.col(f"`{path}`").alias("p"), column.alias("t"), whole.alias("w"))
    found = stored(holding.select(F.col("p").alias("path"), F.explode(blocks(F.col("t"), F.col("w"), needed, good)).alias("line")), "lines")
    lines = stored(best_lines(found.select("line").distinct(), n, df, vectors, least), "licences")
    best = F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence"))
    own = stored(
        found.where("path is not null").join(lines, "line").groupBy("path").agg(best.alias("b")).select("path", "b.licence", "b.score"),
        "own",
    )
    votes = (
        own.where(F.rlike("path", F.lit(licence_file)))
        .groupBy(parent(F.col("path")).alias("dir"), "licence")
        .agg(F.count("*").alias("n"))
        .groupBy("dir")
        .agg(F.min_by("licence", F.struct(-F.col("n"), "licence")).alias("licence"))
    )
    dirs = files.where(F.col(f"`{path}`").isNotNull()).select(parent(F.col(f"`{path}`")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(above)).alias("up"))
        .join(votes.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("up").alias("n"), "up", "licence")).alias("u"))
        .select(F.col("dir").alias(f"dir_{tag}"), F.col("u.up").alias(f"up_{tag}"), F.col("u.licence").alias(f"given_{tag}"))
    )
    mine = own.select(F.col("path").alias(f"path_{tag}"), F.col("licence").alias(f"own_{tag}"), F.col("score").alias(f"score_{tag}"))
    kept = [F.col(f"`{c}`") for c in files.columns if c not in ADDED]
    joined = files.select(*kept).join(mine, F.col(f"`{path}`") == F.col(f"path_{tag}"), "left").join(
        nearest, parent(F.col(f"`{path}`")) == F.col(f"dir_{tag}"), "left"
    )
    return joined.select(
        *kept,
        F.col(f"own_{tag}").alias("own_licence"),
        F.col(f"score_{tag}").alias("score"),
        F.coalesce(f"own_{tag}", f"given_{tag}").alias("licence"),
        F.when(F.col(f"own_{tag}").isNull(), F.col(f"up_{tag}")).alias("licence_of"),
    )

"""License scans in DataFrame operations alone: TF-IDF cosine to templates, then inheritance from the nearest directory.

Units are the lines of whole texts, their blocks (adjacent lines between ones without a letter or digit, so that a header
may wrap and carry comment marks), and whole texts. Their terms (runs of ASCII letters and digits in lower case) get TF-IDF
weights; the inverse document frequency comes from the templates, and a term that no template has weighs as the rarest. A
unit's license is that of the template with the greatest cosine, if it reaches the threshold; a single term says nothing. Templates are license texts,
headers, titles and identifier tags; the templates are a constant, and so is the size of what is broadcast.

Term frequencies count as 1 + ln n. Every unit is looked at, but only those that can reach a threshold are scored: the cosine
with a template is at most the root of the sum of the squared weights of the template's terms that a unit has, so a unit
without any of a template's ``telling_terms`` cannot reach it; these are all of its terms but common words (a template needs
another word in common with a unit than those) and some whose squared weights add up, with those, to less than the squared
threshold. Of those units the weights are made in place, row by row, and a unit whose unknown terms outweigh its known ones
too far is left out as well (``weigh_units`` states the bound). Only what is left moves, as digests and at most a vocabulary
of weights; it is made distinct first, so a header that a third of the files share is scored once.

A file's own license is that of its best line or block. A licence file is one whose whole text reaches ``file_threshold``
against a full license text, or one that is named as such (``LICENSE``, ``COPYING`` and the like) and has an own license; it
also gives its directory a license. A file without an own license takes that of the nearest directory above it that has one:
the distinct directories are exploded to their ancestors and joined to the directories that have a license.

Defined results: null and empty texts have no unit; a null path inherits nothing and gives nothing, but a text's own license
does not depend on its path. Rows that share a path and not the text are scanned one by one. Ties between templates go to the
name that comes first (a license without its version gives way to any other), ties between a directory's licence files to the greater score, then the smaller path, then the name
that comes first. Repeated rows get equal results, one for each row; an empty table gives an empty one. Columns besides the
named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import pick, stash

# --- fixed values: SPDX identifiers, and public texts, headers, titles and statements of these licenses ----------------

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
    "this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
UNLICENSE_TEXT = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
    "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
    "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and "
    "to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    "software under copyright law."
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GPL_HEADER = (
    "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version."
)
GPL_NOTICE = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU {name} General Public License for more details."
)
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
#: (license, full text)
TEXTS = (
    ("MIT", f"{MIT_GRANT} {MIT_REST}"),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_REST}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THREE} {BSD_REST}"),
    ("ISC", ISC_TEXT),
    ("Unlicense", UNLICENSE_TEXT),
)
#: The GNU family: (license, name, version, date in the title)
GNU = (
    ("GPL-2.0", "", "2", "June 1991"),
    ("GPL-3.0", "", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero", "3", "19 November 2007"),
)
#: (license, what a header, a title or a sentence says)
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to You under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", BSD_GRANT),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LicenseRef-GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", MIT_GRANT),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TAGS = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "EPL-2.0", "BSL-1.0", "Zlib")
GNU_TAGS = ("", "-only", "-or-later")

#: Common words and numbers: a unit that has no other term of a template is no statement of it.
COMMON = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "be", "by", "at", "or", "from", "an", "this", "was", "are", "not", "you", "any", "if", "its", "may", "no", "under",
    "all", "been", "but", "can", "do", "either", "has", "have", "however", "more", "nor", "one", "other", "our", "out", "see", "so", "there", "we", "which", "who", "whom", "will",
    "0", "1", "2", "3", "4",
)

# --- end of the fixed values ---------------------------------------------------------------------------------------------


def _templates() -> Iterable[tuple[str, bool, str]]:
    for name, text in TEXTS:
        yield name, True, text
    yield from ((name, False, text) for name, text in STATEMENTS)
    yield "Apache-2.0", False, APACHE_HEADER
    yield "MPL-2.0", False, MPL_HEADER
    for tag in TAGS:
        yield tag, False, f"SPDX-License-Identifier: {tag}"
    for tag, name, version, date in GNU:
        header, notice = (x.format(colon=":", name=name, version=version) for x in (GPL_HEADER, GPL_NOTICE))
        yield tag, False, header
        yield tag, False, f"{header} {notice}"
        yield tag, False, f"GNU {name} General Public License Version {version}"
        yield tag, False, f"GNU {name} General Public License Version {version}, {date}"
        yield tag, False, f"This work is licensed under the GNU {name} General Public License, version {version}."
        yield from ((tag, False, f"SPDX-License-Identifier: {tag}{end}") for end in GNU_TAGS)


#: (license, whether it is a full license text, text)
TEMPLATES: tuple[tuple[str, bool, str], ...] = tuple(_templates())
TERM = "[a-z0-9]+"
#: What separates blocks: line ends with lines between that have neither letter nor digit of ASCII.
BETWEEN_BLOCKS = r"\n(?:[^A-Za-z0-9\n]*\n)+"
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([-._][^/]*)?$"


def template_weights(templates: tuple[tuple[str, bool, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, bool, str, float]], dict[str, float], float]:
    """(rows (template, license, full text?, term, unit weight), inverse document frequency by term, that of unknown terms)."""
    terms = [Counter(re.findall(TERM, text.lower())) for *_, text in templates]
    spread = Counter(t for c in terms for t in c)
    idf = {t: 1.0 + math.log((1 + len(templates)) / (1 + n)) for t, n in sorted(spread.items())}
    rows = []
    for i, ((name, full, _), counts) in enumerate(zip(templates, terms)):
        own = {t: (1.0 + math.log(n)) * idf[t] for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(w * w for w in own.values()))
        rows += [(i, name, full, t, w / norm) for t, w in own.items()]
    return rows, idf, 1.0 + math.log(1 + len(templates))


def telling_terms(threshold: float, full: bool, templates: tuple[tuple[str, bool, str], ...] = TEMPLATES) -> list[str]:
    """Terms of which a unit has one at least if its cosine with any template (or any full text) reaches the threshold."""
    left: dict[int, float] = {}
    own: dict[int, list[tuple[float, str]]] = {}
    for i, _, is_full, term, weight in template_weights(templates)[0]:
        if (is_full or not full) and term in COMMON:
            left[i] = left.get(i, 0.0) - weight * weight
        elif is_full or not full:
            own.setdefault(i, []).append((weight, term))
    found = set()
    for i, weights in own.items():
        rest = threshold * threshold - 1e-6 + left.get(i, 0.0)
        for weight, term in sorted(weights):
            rest -= weight * weight
            if rest <= 0:
                found.add(term)
    return sorted(found)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def weigh_units(units: DataFrame, threshold: float, templates: tuple[tuple[str, bool, str], ...] = TEMPLATES) -> DataFrame:
    """Units (tid, s, whole) -> (tid, sid, whole, norm, known): the weights of the terms that templates have, of those units
    of two terms or more that may reach the threshold.

    With a template that has a share c of its squared weights in common words, the cosine is at most (root of c times the
    norm of the unit's common words + the norm of its other known terms) / the norm of all its terms.
    """
    rows, idf, unknown = template_weights(templates)
    of_common = Counter()
    for i, _, _, term, weight in rows:
        of_common[i] += weight * weight * (term in COMMON)
    names, common = F.array(*map(F.lit, idf)), F.array(*map(F.lit, COMMON))
    idfs = F.map_from_arrays(names, F.array(*map(F.lit, idf.values())))
    tf = lambda n: F.lit(1.0) + F.log(n)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    root = lambda ks: F.sqrt(total(F.transform(ks, lambda k: k.w * k.w)))
    # equal terms lie next to each other; a term's count is the way to the next one's start
    table = units.select("tid", F.md5("s").alias("sid"), "whole", F.sort_array(terms_of(F.col("s"))).alias("sorted"))
    at = lambda xs, i: F.get(F.col(xs), i)
    starts = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: ~at("sorted", i).eqNullSafe(at("sorted", i - 1)))
    table = table.withColumn("starts", starts)
    table = table.select(
        "tid",
        "sid",
        "whole",
        F.transform("starts", lambda i: at("sorted", i)).alias("terms"),
        F.transform("starts", lambda i, k: tf(F.coalesce(at("starts", k + 1), F.size("sorted")) - i)).alias("tfs"),
    )
    table = table.withColumn("own", F.array_intersect("terms", names))
    known = F.transform("own", lambda t: F.struct(t.alias("term"), (at("tfs", F.array_position(F.col("terms"), t).cast("int") - 1) * F.element_at(idfs, t)).alias("w")))
    others = total(F.transform("terms", lambda t, k: F.when(F.array_contains(F.col("own"), t), F.lit(0.0)).otherwise(at("tfs", k) * at("tfs", k))))
    table = table.select("tid", "sid", "whole", F.size("terms").alias("n"), known.alias("known"), (others * F.lit(unknown * unknown)).alias("others"))
    is_common = lambda k: F.array_contains(common, k.term)
    table = table.select(
        "tid",
        "sid",
        "whole",
        "n",
        "known",
        F.sqrt(F.col("others") + total(F.transform("known", lambda k: k.w * k.w))).alias("norm"),
        (F.lit(math.sqrt(max(of_common.values()))) * root(F.filter("known", is_common)) + root(F.filter("known", lambda k: ~is_common(k)))).alias("most"),
    )
    # as a generated row, for a plain condition would be pushed down and all of the above evaluated again for each of its columns
    reaches = (F.col("n") > 1) & (F.col("most") >= F.lit(threshold - 1e-6) * F.col("norm"))
    kept = table.select("tid", "sid", "whole", F.explode_outer(F.when(reaches, F.array(F.struct("norm", "known")))).alias("kept"))
    return kept.where("kept IS NOT NULL").select("tid", "sid", "whole", "kept.norm", "kept.known")


def score_statements(statements: DataFrame, templates: tuple[tuple[str, bool, str], ...] = TEMPLATES) -> DataFrame:
    """Distinct statements (sid, norm, known) -> (sid, license, score, file_license, file_score): the best of all templates that
    share a term with one, and the best of the full texts."""
    rows = template_weights(templates)[0]
    lines = (f"({i}, '{n}', {str(f).lower()}, '{t}', {w!r}D)" for i, n, f, t, w in rows)
    weights = statements.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(lines)} AS t(template, license, full, term, weight)")
    terms = statements.select("sid", "norm", F.inline("known"))
    dots = terms.join(F.broadcast(weights), "term").groupBy("sid", "norm", "template", "license", "full").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count_if(~F.col("term").isin(*COMMON)).alias("n_own")).where("n_own > 0")
    each = dots.select("sid", "license", "full", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = F.struct((-F.col("score")).alias("m"), "license")
    found = each.groupBy("sid").agg(F.min(best).alias("b"), F.min(F.when(F.col("full"), best)).alias("f"))
    return found.select("sid", "b.license", (-F.col("b.m")).alias("score"), F.col("f.license").alias("file_license"), (-F.col("f.m")).alias("file_score"))


def parent(path: Column) -> Column:
    """The directory of a path: what comes before the last slash ("" for the root)."""
    return F.regexp_replace(path, "/[^/]*$", "")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", keys: tuple[str, ...] = (), threshold: float = 0.6, file_threshold: float = 0.75, templates: tuple[tuple[str, bool, str], ...] = TEMPLATES) -> DataFrame:
    """One row per input row: ``keys``, path, own_license, own_score, licence_file, license and inherited_from (a directory)."""
    ids = [f"c{i + 2}" for i in range(len(keys))]
    table = pick(files, path_col, text_col, *keys).withColumnsRenamed({"c0": "path", "c1": "text"}).withColumn("tid", F.md5("text"))
    telling, of_texts = (F.array(*map(F.lit, telling_terms(x, full, templates))) for x, full in ((threshold, False), (file_threshold, True)))
    has = lambda s, terms: F.arrays_overlap(terms_of(F.col(s)), terms)
    texts = table.where(F.col("text").isNotNull() & has("text", F.array_union(telling, of_texts))).select("tid", "text")
    parts = F.array_distinct(F.concat(F.split("text", "\n", -1), F.split("text", BETWEEN_BLOCKS, -1)))
    lines = texts.select("tid", F.explode(parts).alias("s")).where(has("s", telling)).withColumn("whole", F.lit(False))
    whole = texts.where(has("text", of_texts)).select("tid", F.col("text").alias("s"), F.lit(True).alias("whole"))
    # the few units that may reach a threshold are stored once, by digests and weights; their texts are neither moved nor stored
    units = stash(weigh_units(lines, threshold, templates).unionByName(weigh_units(whole, file_threshold, templates)).dropDuplicates(["tid", "sid", "whole"]))
    scores = stash(score_statements(units.select("sid", "norm", "known").dropDuplicates(["sid"]), templates))
    scored = units.select("tid", "sid", "whole").join(scores, "sid")
    vague = F.startswith(F.col("license"), F.lit("LicenseRef-"))
    best = F.min(F.when(~F.col("whole") & (F.col("score") >= threshold), F.struct(vague.alias("vague"), (-F.col("score")).alias("m"), "license")))
    as_file = F.min(F.when(F.col("whole") & (F.col("file_score") >= file_threshold), F.struct((-F.col("file_score")).alias("m"), F.col("file_license").alias("license"))))
    of_text = scored.groupBy("tid").agg(best.alias("b"), as_file.alias("f"))
    own = stash(of_text.select("tid", F.col("b.license").alias("own_license"), (-F.col("b.m")).alias("own_score"), F.col("f.license").alias("text_license"), (-F.col("f.m")).alias("text_score")).where("own_license IS NOT NULL OR text_license IS NOT NULL"))

    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    narrow = table.select(*ids, "path", parent(F.col("path")).alias("dir"), "tid")
    licensed = narrow.join(own, "tid", "left").withColumn("file_license", F.coalesce("text_license", F.when(named, F.col("own_license")))).withColumn("file_score", F.when(F.col("text_license").isNotNull(), F.col("text_score")).otherwise(F.col("own_score")))
    given = licensed.where("file_license IS NOT NULL AND path IS NOT NULL").groupBy(F.col("dir").alias("from")).agg(F.min(F.struct((-F.col("file_score")).alias("m"), "path", "file_license")).alias("g"))
    given = given.select("from", F.col("g.file_license").alias("license"))
    dirs = table.where("path IS NOT NULL").select(parent(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/", -1)
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("from"))
    nearest = above.join(given, "from").groupBy("dir").agg(F.max(F.struct(F.length("from").alias("n"), "from", "license")).alias("x")).select("dir", F.col("x.from").alias("from"), F.col("x.license").alias("inherited"))
    none = F.col("own_license").isNull()
    return licensed.join(nearest, "dir", "left").select(
        *(F.col(i).alias(k) for i, k in zip(ids, keys)),
        F.col("path").alias(path_col),
        "own_license",
        "own_score",
        F.col("file_license").isNotNull().alias("licence_file"),
        F.coalesce("own_license", "inherited").alias("license"),
        F.when(none, F.col("from")).alias("inherited_from"),
    )

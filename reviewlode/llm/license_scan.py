"""License detection by sparse TF-IDF cosine to templates, and inheritance along directories.

Every line of a text that may hold a notice is compared with the templates, and so is the whole text, which may
be a licence file. A term weighs ``(1 + log tf) * idf``; document frequencies come from all texts.
Only terms of templates matter for the dot product, and a segment can reach the threshold only if it holds one of
a template's *anchors*: the rest of the template is too short a vector (Cauchy-Schwarz). So most lines are passed
over after one look.
Full licence texts, usual headers and SPDX lines are templates too (``LONGER``). A text with a mark of a licence is compared
as a whole with all of them, and with each in windows of the template's length, placed by terms that the template holds
once; so wrapping and comment signs do not matter. A file without a licence of its own takes that of the nearest directory above it that holds
a licence file. All work is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlode.llm.common import small
from reviewlode.session import land

THRESHOLD = 0.6
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Short notices; each names its licence. Fixed texts.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style 3-clause license."),
    ("mpl-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
]
# What each of the longer templates holds, and so every text that is compared with them.
MARKS = "(?i)licen[cs]|copyright|redistribut|spdx"
# Terms that place a template's windows, and starts of windows within a template's length.
ANCHORS, STARTS = 5, 8
HEADERS = [
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
    with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
    received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
    received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation,
    Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by-4.0", """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
    license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA
    94042, USA."""),
    ("cc-by-nc-4.0", """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a
    copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866,
    Mountain View, CA 94042, USA."""),
]
SPDX = ["apache-2.0", "mit", "gpl-3.0", "gpl-2.0", "lgpl-3.0", "cc-by-nc-4.0", "cc-by-4.0", "cc0-1.0", "bsd-3-clause", "mpl-2.0"]
# The same licence under other ids.
SPDX_FORMS = {"gpl-3.0": ["only", "or-later"], "gpl-2.0": ["only", "or-later"], "lgpl-3.0": ["only", "or-later"]}


def _longer() -> list[tuple[str, str, bool]]:
    """(licence, text, full): full licence texts, headers and SPDX lines."""
    texts = [(f.stem, f.read_text(encoding="utf-8"), True) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    ids = [(i, x) for i in SPDX for x in [i, *(f"{i}-{form}" for form in SPDX_FORMS.get(i, []))]]
    return [*texts, *((i, t, False) for i, t in HEADERS), *((i, f"SPDX-License-Identifier: {x}", False) for i, x in ids)]


LONGER = _longer()


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _frequencies(terms: Column) -> Column:
    """(term, n) of a list of terms, by sorting it within the row."""

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda p: cut(s, p))[0]

    def cut(s: Column, p: Column) -> Column:
        end = F.size(s)
        return F.transform(
            p, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(p, k + 1), end) - i).alias("n"))
        )

    return F.transform(F.array(F.array_sort(terms)), runs)[0]


def _split(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def idf_of_terms(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, float]:
    """idf over ``docs`` of every term of the vocabulary."""
    mine = F.array(*[F.lit(t) for t in vocabulary])
    # A term of the vocabulary is looked for once per text; tasks send one row per term.
    held = F.array_intersect(_terms(F.coalesce(F.col(text), F.lit(""))), mine)
    total = docs.count()
    found = docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in found.collect()}  # one row per term of a template
    return {t: math.log((total + 1.0) / (df.get(t, 0) + 1.0)) + 1.0 for t in vocabulary}


def unit_weights(terms: list[str], idfs: dict[str, float]) -> dict[str, float]:
    """Weights of unit length of a template's terms."""
    weight = {t: (1 + math.log(n)) * idfs[t] for t, n in sorted(Counter(terms).items())}
    norm = math.sqrt(sum(w * w for w in weight.values()))
    return {t: w / norm for t, w in weight.items()}


def anchors(rows: list[tuple[str, str, float]], threshold: float) -> list[str]:
    """Terms of which a segment needs one: without any, its cosine with every template is below the threshold."""
    needed: set[str] = set()
    by_license: dict[str, list[tuple[float, str]]] = {}
    for license_id, term, weight in rows:
        by_license.setdefault(license_id, []).append((weight, term))
    for terms in by_license.values():
        left = 0.0
        for weight, term in sorted(terms):
            left += weight * weight
            if left >= threshold * threshold:
                needed.add(term)
    return sorted(needed)


def own_licenses(
    files: DataFrame,
    key: str,
    text: str,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    longer: list[tuple[str, str, bool]] = LONGER,
) -> DataFrame:
    """(key, license, cosine, whole) of files with a licence of their own: the best segment's.

    Ties go to the licence that sorts first. ``whole`` says that the text as a whole is the licence. A text that is
    a full licence text is that, whatever headers it holds.
    """
    noticed = {license_id: _split(t) for license_id, t in templates}
    everything = {t for terms in [*noticed.values(), *(_split(x) for _, x, _ in longer)] for t in terms}
    all_idfs = idf_of_terms(files, text, sorted(everything))
    idfs = {t: all_idfs[t] for terms in noticed.values() for t in terms}
    other = max([*idfs.values(), 1.0])
    unit_rows = [(name, t, w) for name, terms in noticed.items() for t, w in unit_weights(terms, idfs).items()]
    needs = F.array(*[F.lit(t) for t in anchors(unit_rows, threshold)])
    idf_of = F.create_map(*[F.lit(x) for pair in sorted(idfs.items()) for x in pair])
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)
    cheap = "(?i)" + "|".join(t.replace(".", r"\.") for t in anchors(unit_rows, threshold))
    noted = F.filter(lines, lambda x: x.rlike(cheap))
    alone = F.size(lines) == 1
    headers = F.transform(noted, lambda x: F.struct(alone.alias("whole"), x.alias("s")))
    entire = F.array(F.struct(F.lit(True).alias("whole"), whole.alias("s")))
    segments = F.when((F.size(noted) > 0) & ~alone, F.concat(headers, entire)).otherwise(headers)
    rows = files.select(F.col(key).alias("key"), F.explode(segments).alias("seg"))
    rows = rows.select("key", "seg.whole", _terms(F.col("seg.s")).alias("terms")).where(F.arrays_overlap("terms", needs))
    weighed = F.transform(
        _frequencies(F.col("terms")),
        lambda t: F.struct(
            t["term"].alias("term"), ((1 + F.log(t["n"])) * F.coalesce(idf_of[t["term"]], F.lit(other))).alias("w")
        ),
    )
    rows = rows.select("key", "whole", weighed.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    rows = rows.withColumn("length", length)
    by_license: dict[str, list] = {}
    for license_id, term, weight in unit_rows:
        by_license.setdefault(license_id, []).append((term, weight))

    def cosine(terms: list[tuple[str, float]]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in sorted(terms) for x in pair])
        return F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(table[x["term"]], F.lit(0.0))) / F.col("length")

    # Equal cosines: the name that sorts first has the largest turn.
    cosines = [
        F.struct(cosine(terms).alias("cosine"), F.lit(-turn).alias("turn"), F.lit(name).alias("license"))
        for turn, (name, terms) in enumerate(sorted(by_license.items()))
    ]
    best = F.array_max(F.array(*cosines))
    rows = rows.select("key", "whole", best.alias("best")).where(F.col("best.cosine") >= threshold)
    rows = rows.select("key", "whole", "best.cosine", "best.license", F.lit(False).alias("full"))
    if longer:
        rows = rows.unionByName(_long_matches(files, key, text, longer, all_idfs, threshold))
    top = rows.groupBy("key").agg(F.max_by(F.struct("license", "cosine", "whole"), F.struct("full", "cosine", "whole")).alias("top"))
    return top.select(F.col("key").alias(key), "top.license", "top.cosine", "top.whole")


def _long_matches(
    files: DataFrame, key: str, text: str, longer: list[tuple[str, str, bool]], idfs: dict[str, float], threshold: float
) -> DataFrame:
    """(key, whole, cosine, license, full) of texts and windows that reach the threshold of a longer template."""
    spark = files.sparkSession
    places, units = [], []
    for no, (license_id, template, full) in enumerate(longer):
        terms = _split(template)
        once = {t: i for i, t in enumerate(terms) if terms.count(t) == 1}
        rare = sorted(once, key=lambda t: (-idfs[t], once[t]))[: ANCHORS * 4]
        rare = sorted(rare, key=once.get)[:: max(1, len(rare) // ANCHORS)]  # spread over the template
        places.append((no, len(terms), max(1, len(terms) // STARTS), {t: once[t] for t in rare}))
        units += [(no, license_id, full, t, w, idfs[t]) for t, w in unit_weights(terms, idfs).items()]
    templates = F.broadcast(spark.createDataFrame(places, "no int, length int, step int, anchors map<string, int>"))
    unit = F.broadcast(spark.createDataFrame(units, "t_no int, license string, full boolean, term string, unit double, idf double"))
    marked = files.where(F.col(text).rlike(MARKS)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Rows that repeat key and text are one.
    marked = land(marked.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n")).select("key", "text"), "marked")
    listed = marked.select("key", F.xxhash64("text").alias("print"), _terms(F.col("text")).alias("terms"))
    at = F.filter(F.transform("terms", lambda x, i: i - F.col("anchors")[x]), lambda p: p.isNotNull())
    starts = F.array_distinct(F.transform(at, lambda p: F.greatest(F.lit(0), F.floor(p / F.col("step")) * F.col("step")).cast("int")))
    held = F.arrays_overlap("terms", F.map_keys("anchors"))
    windows = listed.join(templates, held).withColumn("start", F.explode(starts))
    windows = windows.select("key", "print", "no", "start", F.slice("terms", F.col("start") + 1, F.col("length")).alias("terms"))
    entire = listed.select("key", "print", F.lit(None).cast("int").alias("no"), F.lit(0).alias("start"), "terms")
    known = unit.groupBy("term").agg(F.first("idf").alias("known"))
    other = max([*idfs.values(), 1.0])
    segment = ["key", "print", "no", "start"]
    spread = windows.unionByName(entire).where(F.size("terms") > 0).select(*segment, F.explode(_frequencies(F.col("terms"))).alias("v"))
    spread = spread.select(*segment, F.col("v.term").alias("term"), (1 + F.log("v.n")).alias("tf"))
    spread = land(spread.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("known", F.lit(other))), "segments")
    lengths = spread.groupBy(*segment).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    shared = spread.join(unit, ["term"]).where("no is null or no = t_no")
    shared = shared.groupBy(*segment, "t_no", "license", "full").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    names = {c: f"s_{c}" for c in segment}
    lengths = lengths.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    found = shared.join(lengths, same).withColumn("cosine", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("cosine") >= threshold)
    whole = F.col("no").isNull()
    return found.select("key", whole.alias("whole"), "cosine", "license", (whole & F.col("full")).alias("full"))


def directories(path: Column) -> Column:
    """Directories above a path, nearest first; the root is the empty text."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(
    files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(key, path, license, cosine, origin) of every file; origin is ``file``, ``header``, ``inherited`` or ``none``.

    A licence file is a text that is a licence as a whole; it speaks for its directory and those below. Of several
    in a directory the best one does. A null path has no directory; null and empty texts have no licence. Rows
    that repeat a key share the key's best licence.
    """
    own = land(own_licenses(files, key, text, templates, threshold), "licenses")
    marks = own.select(F.col(key).alias("own_key"), "license", "cosine", "whole")
    placed = land(files.select(F.col(key).alias("key"), F.col(path).alias("path")), "paths")
    placed = placed.join(small(marks), F.col("key").eqNullSafe(F.col("own_key")), "left").drop("own_key")
    near = F.get(directories(F.col("path")), F.lit(0))
    placed = land(placed.withColumn("dir", near), "files")
    # One row per directory that holds a licence file, and one per directory and ancestor.
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", F.col("license")))
    given = placed.where("whole and dir is not null").groupBy("dir").agg(best.alias("given"))
    given = given.select(F.col("dir").alias("above"), F.col("given.license").alias("from_dir"))
    steps = F.posexplode(F.array_insert(directories(F.col("dir")), 1, F.col("dir"))).alias("up", "above")
    known = placed.where("dir is not null").select("dir").distinct()
    chain = known.select("dir", steps).join(small(given), "above")
    nearest = chain.groupBy("dir").agg(F.min_by("from_dir", "up").alias("from_dir"))
    out = placed.join(small(nearest), "dir", "left")
    origin = F.when(F.col("whole"), "file").when(F.col("license").isNotNull(), "header").when(F.col("from_dir").isNotNull(), "inherited")
    return out.select(
        F.col("key").alias(key),
        F.col("path").alias(path),
        F.coalesce("license", "from_dir").alias("license"),
        F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        F.coalesce(origin, F.lit("none")).alias("origin"),
    )

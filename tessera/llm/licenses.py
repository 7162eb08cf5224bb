"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a text are the whole text, its blocks (parted by blank lines), its lines, and its runs of words. Normalising lower-cases A-Z
and turns every run of other characters than [a-z0-9] into a space. A unit and a template are sets of word bigrams A
and B with Dice 2|A & B| / (|A| + |B|). A template can only reach the threshold t if |A| lies between |B| t / (2 - t)
and |B| (2 - t) / t: units outside every template's bounds are dropped before bigrams are made (a unit of w words, d of them distinct, has
w - 1 bigrams at most and d - 1 at least), and each unit is compared only with templates within its bounds.

Templates are notices and lines, and the full texts of licences, of more than LONG bigrams. A full text is found as a whole text or a
block of one; in other places its notice, or its parts in blocks, are what there is to find.

Runs are windows over the words of the whole text, so a notice is found over several paragraphs, in wrapped lines and inside
a line. The best window of a template begins and ends with bigrams of it, as others at its ends only lower its Dice: from each
such bigram that has enough of the template's behind it, every window that ends in one, up to the longest, is compared. Of windows
that overlap the one that shares most bigrams with its template stands, so a notice is not also reported as a shorter or similar one
in it. A run is a hit if its template is none of the other units'; each template has one, its best. ``n_units`` does not count runs.

A unit or run that reaches the threshold shares at least ``need`` bigrams with its template, hence at least one with a word
of ``anchors``: texts without any such word are not compared with templates of at most LONG bigrams.

Only DataFrame functions are used, on each row alone: nothing is shuffled, so hot keys do not exist, and a lost
executor's rows are simply read again. The templates are a constant of fixed size in the plan.

Defined results: null, empty and one-word texts have no licence; of equal Dice the template first by name is the best; rows that repeat
give equal rows; an empty table gives an empty result; columns of the input named like the results (``licenses``, ``n_units``,
``best_license``, ``best_dice``) are replaced, all others stay. Whole texts are scanned, however long.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, read

THRESHOLD = 0.8
#: Bigrams of the largest template that runs of words are compared with.
LONG = 400

#: Full texts of public licences, by the names of their files.
FULL_TEXTS = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "templates").glob("*.txt"))}

#: Notices, lines and short texts of public licences.
TEMPLATES = FULL_TEXTS | {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-line": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-line": "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    "cc0-1.0-short": "Licensed under CC0 1.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Words that are taken last as anchors; which ones changes no result.
_COMMON = frozenset("a an and any as at by be for from in is it no not of on or that the this to under with you".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).strip().split(" ")


def grams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams of a unit that can reach the threshold with n in the template."""
    sizes = [a for a in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(a, n) / (a + n) >= threshold]
    return (sizes[0], sizes[-1]) if sizes else (1, 0)


def need(n: int, threshold: float) -> int:
    """Least number of bigrams shared by a template of n and a unit that reaches the threshold."""
    lo, _ = bounds(n, threshold)  # more bigrams in the unit need no fewer shared ones
    k = max(1, int(threshold * (lo + n) / 2) - 1)
    while 2 * k / (lo + n) < threshold:
        k += 1
    return k


def anchors(templates: list[list[str]], threshold: float) -> list[str]:
    """Words such that every unit that reaches the threshold with a template (its bigrams) has one of them. Any choice that
    leaves fewer than ``need`` bigrams without such a word will do; long words are taken first, as they are rarer."""
    out: set[str] = set()
    for g in templates:
        rest = [b.split(" ") for b in g]
        for word in sorted({w for b in rest for w in b}, key=lambda w: (w in _COMMON, -len(w), w)):
            rest = [b for b in rest if not out.intersection(b)]
            if len(rest) < need(len(g), threshold):
                break
            if any(word in b for b in rest):
                out.add(word)
    return sorted(out)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def units(text: Column) -> Column:
    """Distinct normalised units: whole text, blocks, lines."""
    # \\W is some twenty times faster than a class of the same characters; it keeps _, which stands for the line feeds here. Only
    # ASCII is left when letters become small, so this is the lower case of A-Z alone
    plain = F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "_\n", " _"), r"\W+", " "))
    tight = F.replace(F.replace(plain, F.lit(" _"), F.lit("_")), F.lit("_ "), F.lit("_"))
    block = lambda x: F.trim(F.replace(x, F.lit("_"), F.lit(" ")))

    def each(p: Column) -> Column:
        lines = F.transform(F.split(p, "_"), lambda x: F.trim(x))
        parted = F.when(F.contains(p, F.lit("__")), F.transform(F.split(p, "__+"), block)).otherwise(F.array().cast("array<string>"))
        return let(lines, lambda x: F.array_distinct(F.concat(F.array(F.array_join(F.filter(x, lambda w: w != ""), " ")), parted, x)))

    return let(tight, each)


def runs(text: Column, known: list[tuple[str, list[str], int]], threshold: float) -> Column:
    """Array of struct(dice, rank, name, n): the best run of each template of ``known`` (name, bigrams, repeats of bigrams in
    it) among those that stand."""
    every = sorted({b for _, g, _ in known for b in g})
    i32 = lambda x: F.lit(x).cast("int")

    def window(v: Column, start: Column, g: list[str], name: str, rank: int) -> Column:
        """The best window that begins at ``start``, whose bigrams from there on are ``v``."""

        def step(acc: Column, x: Column) -> Column:
            both = F.struct((acc["n"] + 1).alias("n"), (acc["a"] + x["new"]).alias("a"), (acc["k"] + x["new"] * x["own"]).alias("k"))
            return let(both, lambda b: let(2.0 * b["k"] / (b["a"] + len(g)), lambda dice: let((x["own"] == 1) & (dice > acc["dice"]), lambda better: F.struct(
                b["n"].alias("n"), b["a"].alias("a"), b["k"].alias("k"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"),
                F.when(better, b["n"]).otherwise(acc["len"]).alias("len"), F.when(better, b["k"]).otherwise(acc["shared"]).alias("shared"), F.when(better, b["a"]).otherwise(acc["size"]).alias("size")))))

        marks = F.transform(v, lambda x, i: F.struct((F.array_position(v, x) == i + 1).cast("int").alias("new"), x.isin(*g).cast("int").alias("own")))
        zero = F.struct(*[i32(0).alias(c) for c in ("n", "a", "k")], F.lit(0.0).alias("dice"), *[i32(0).alias(c) for c in ("len", "shared", "size")])
        return F.aggregate(marks, zero, step, lambda b: F.struct(b["shared"].alias("shared"), b["dice"].alias("dice"), i32(-rank).alias("rank"), F.lit(name).alias("name"), b["size"].alias("n"), start.alias("start"), (start + b["len"] - 1).alias("end")))

    def windows(grams: Column, places: Column, rank: int, name: str, g: list[str], repeats: int) -> Column:
        least, longest = need(len(g), threshold), bounds(len(g), threshold)[1] + repeats
        own = F.transform(F.filter(places, lambda p: p["g"].isin(*g)), lambda p: p["i"])

        def found(q: Column) -> Column:
            at = F.filter(F.sequence(i32(1), F.size(q) - (least - 1)), lambda j: F.element_at(q, j + (least - 1)) - F.element_at(q, j) < longest)
            each = F.transform(at, lambda j: let(F.element_at(q, j), lambda start: let(F.slice(grams, start + 1, i32(longest)), lambda v: window(v, start, g, name, rank))))
            return F.when(F.size(q) >= least, F.filter(each, lambda w: w["dice"] >= threshold))

        return F.coalesce(let(own, found), F.array().cast(kind))

    kind = "array<struct<shared:int,dice:double,rank:int,name:string,n:int,start:int,end:int>>"
    words = F.split(F.trim(F.lower(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" ")), r"\W+", " "))), " ")

    def standing(all_: Column) -> Column:
        """Of windows that overlap the one that shares most bigrams (then: of greatest Dice, first by name, first in the text)."""
        order = F.transform(all_, lambda w: F.struct((-w["shared"]).alias("a"), (-w["dice"]).alias("b"), (-w["rank"]).alias("c"), w["start"].alias("d"), w.alias("w")))
        apart = lambda kept, w: F.when(F.exists(kept, lambda k: (k["start"] <= w["end"]) & (w["start"] <= k["end"])), kept).otherwise(F.concat(kept, F.array(w)))
        return F.aggregate(F.transform(F.array_sort(order), lambda x: x["w"]), F.array().cast(kind), apart)

    def best(kept: Column) -> Column:
        first = F.filter(kept, lambda w: ~F.exists(kept, lambda k: (k["name"] == w["name"]) & ((k["dice"] > w["dice"]) | ((k["dice"] == w["dice"]) & (k["start"] < w["start"])))))
        return F.transform(first, lambda w: F.struct(*[w[c].alias(c) for c in ("dice", "rank", "name", "n")]))

    def of_words(w: Column) -> Column:
        grams = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        places = lambda g: F.filter(F.transform(g, lambda x, i: F.struct(i.alias("i"), x.alias("g"))), lambda p: p["g"].isin(*every))
        return let(grams, lambda g: let(places(g), lambda p: let(F.concat(*[windows(g, p, i, *t) for i, t in enumerate(known)]), lambda all_: let(standing(all_), best))))

    return let(words, of_words)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``licenses`` (array of struct(name, dice, words): the units that match, by their
    best template, in order), ``n_units`` (units within some template's bounds), ``best_license`` and ``best_dice``."""
    known = sorted((name, grams_of(t)) for name, t in templates.items())
    short = [(name, g, len(words_of(templates[name])) - 1 - len(g)) for name, g in known if 0 < len(g) <= LONG]
    known = [(-i, name, g, *bounds(len(g), threshold)) for i, (name, g) in enumerate(known) if g]
    least = min((lo for *_, lo, _ in known), default=1)
    most = max((hi for *_, hi in known), default=0)
    kind = "array<struct<dice:double,rank:int,name:string,n:int>>"
    none = F.array().cast(kind)

    def grams(unit: Column) -> Column:
        """Distinct bigrams of a unit; null where there are more than those of any template's bounds."""
        pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
        few = lambda w: (F.size(w) - 1 <= most) | (F.size(F.array_distinct(w)) - 1 <= most)
        return let(F.split(unit, " "), lambda w: F.when(few(w), pairs(w)))

    def best(g: Column, some: list[tuple]) -> Column:
        """Greatest struct(dice, rank, name) over the templates within the bounds of a set of bigrams."""
        n = F.size(g)
        # a template is one literal, split when the plan is made
        shared = lambda t: F.size(F.array_intersect(g, F.split(F.lit(";".join(t)), ";")))
        each = [F.when(n.between(lo, hi), F.struct((2.0 * shared(t) / (n + len(t))).alias("dice"), F.lit(rank).alias("rank"), F.lit(name).alias("name"), n.alias("n"))) for rank, name, t, lo, hi in some]
        return F.array_max(F.array(*each)) if each else F.lit(None).cast(kind[6:-1])

    # a unit of fewer than least + 1 words has too few bigrams for every template
    long_enough = F.filter(units(F.col(text)), lambda u: (F.length(u) >= 2 * least + 1) & (F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit(""))) >= least))
    ranges: list[list[int]] = []  # the sizes within some template's bounds
    for lo, hi in sorted((lo, hi) for *_, lo, hi in known):
        if ranges and lo <= ranges[-1][1] + 1:
            ranges[-1][1] = max(ranges[-1][1], hi)
        else:
            ranges.append([lo, hi])
    fits = lambda g: reduce(lambda a, b: a | b, [F.size(g).between(lo, hi) for lo, hi in ranges], F.lit(False))
    sets = F.filter(F.transform(long_enough, grams), lambda g: g.isNotNull() & fits(g))
    # the anchors as substrings first, which is cheap, then as words
    some = anchors([g for _, g, _ in short], threshold)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    able = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in some], F.lit(False)) & F.coalesce(F.col(text), F.lit("")).rlike("(?i)(?<![0-9a-z])(?:" + "|".join(some) + ")(?![0-9a-z])")
    edge = max((hi for *_, t, lo, hi in known if len(t) <= LONG), default=0)
    full = [k for k in known if len(k[2]) > LONG]
    made, found = free_names(docs, ["_sets", "_hits"])
    enough = lambda a: F.filter(a, lambda b: b["dice"] >= threshold)
    whole = enough(F.transform(made, lambda g: best(g, known)))
    more = lambda u: F.concat(u, F.filter(runs(F.col(text), short, threshold), lambda r: ~F.exists(u, lambda x: x["name"] == r["name"])))
    large = F.filter(made, lambda g: F.size(g) >= min((lo for *_, lo, _ in full), default=edge + 1))
    hits = F.when(able, let(whole, more)).when(F.size(large) > 0, enough(F.transform(large, lambda g: best(g, full)))).otherwise(none)
    out = docs.withColumn(made, sets).withColumn("n_units", F.size(made).cast("long")).withColumn(found, hits)
    top = F.array_max(found)
    return (
        out.withColumn("licenses", F.transform(found, lambda b: F.struct(b["name"].alias("name"), b["dice"].alias("dice"), b["n"].alias("bigrams"))))
        .withColumn("best_license", top["name"])
        .withColumn("best_dice", top["dice"])
        .drop(made, found)
    )


def op1_license_scans(spark, sf_dir):
    """All documents: number of units within bounds, names found, best template and its Dice coefficient."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        "n_units",
        F.size("licenses").cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"]))), ",").alias("licenses"),
        "best_license",
        F.round("best_dice", 6).alias("best_dice"),
    )


def op1_sql() -> str:
    """DuckDB SQL for op1_license_scans: every unit against every template within its bounds."""
    known = sorted((name, grams_of(t)) for name, t in TEMPLATES.items())
    rows = ", ".join(f"('{n}', {i}, {len(g)}, {bounds(len(g), THRESHOLD)[0]}, {bounds(len(g), THRESHOLD)[1]}, {g!r})" for i, (n, g) in enumerate(known))
    return f"""
    with t(name, i, n, lo, hi, grams) as (values {rows}),
    p as (select doc_id, regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') as plain from documents),
    u as (select doc_id, unnest(list_distinct(list_transform(list_concat(list_concat([plain], regexp_split_to_array(plain, '\\n(?: ?\\n)+')), regexp_split_to_array(plain, '\\n')),
          lambda x: trim(regexp_replace(x, '[ \\n]+', ' ', 'g'))))) as unit from p),
    w as (select doc_id, unit, string_split(unit, ' ') as w from u),
    g as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) as g from w where len(w) > 1),
    m as (select doc_id, unit, max({{'dice': 2.0::double * len(list_intersect(g.g, t.grams)) / (len(g.g) + t.n), 'rank': -t.i, 'name': t.name}}) as b
          from g join t on len(g.g) between t.lo and t.hi group by doc_id, unit),
    a as (select doc_id, count(*) as n_units, count(*) filter (where b.dice >= {THRESHOLD}) as n_hits,
                 array_to_string(list_sort(list_distinct(list(b.name) filter (where b.dice >= {THRESHOLD}))), ',') as licenses,
                 max(b) filter (where b.dice >= {THRESHOLD}) as top from m group by doc_id)
    select documents.doc_id, coalesce(n_units, 0)::bigint as n_units, coalesce(n_hits, 0)::bigint as n_hits, coalesce(licenses, '') as licenses,
           top.name as best_license, round(top.dice, 6) as best_dice
    from documents left join a using (doc_id)"""

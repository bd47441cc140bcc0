"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every template is compared with all windows of a text that are about as long as the template, across line breaks.
Templates are short notices, standard headers and licence texts; TITLES count only where none of those is found.
An SPDX identifier counts as it stands.  Weights of the templates' words come from their document frequencies over
all files; a word that no template has weighs as one that no file has.  A window can reach the threshold only if it
holds one of the template's heaviest words, so only texts with such a word are weighed; that drops nothing.

Templates of neighbouring licences differ in a word or a number that weighs little.  So a window must also hold the
marks of its template, the family's name and the version, no mark of a GNU licence that the template lacks, and it
must not be denied ("not released under").  A version is the same with ``v`` before it or ``.0`` after it.
An SPDX expression of several licences is given as it stands; ``NONE`` and ``NOASSERTION`` state none.

The best notice of a file is its own licence.  If the file is named as a licence file, or notices make up
FILE_SHARE of its words, it also speaks for its directory and all below it that have none nearer.  A file
without a notice takes the licence of the nearest such directory.  Directories, not files, are joined with
their ancestors, so a directory with very many files is one row there.

Null and empty texts have no notice but inherit; a null path has no directory and inherits nothing.  Of
equal notices the one first in the list of templates counts, of several licence files in a directory the
one with the best score, then the first path.  Repeated rows give the same result each; an empty table an
empty one.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.staging import stage

from .common import bounded_batches, maybe_broadcast, pieces, whole_texts, words_of

# Short notices by the name of the licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-clause license",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-clause license",
    "ISC": "Released under the ISC License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0-long": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0-long": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-4.0-long": "licensed under a Creative Commons Attribution 4.0 International License",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "GPL-2.0-work": "Licensed under the GNU General Public License, version 2",
    "GPL-3.0-work": "Licensed under the GNU General Public License, version 3",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.0": "Licensed under the GNU Library General Public License, version 2",
    "BSD-4-Clause": "Use of this source code is governed by a BSD 4-clause license",
    "Zlib": "Released under the Zlib License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-3.0": "Licensed under CC BY 3.0",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0",
    "CC-BY-ND-4.0-long": "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0-long": "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0-long": "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC0-1.0": "dedicated to the public domain under CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Proprietary": "Copyright. All rights reserved",
}
PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction"
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met"
)
GNU_HEADER = (
    "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License "
    "as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later "
    "version"
)
# Standard headers and licence texts.
TEXTS = {
    "MIT": PERMISSION + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in "
    "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS "
    "FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-3.0": GNU_HEADER.format("", 3),
    "GPL-2.0": GNU_HEADER.format("", 2),
    "LGPL-3.0": GNU_HEADER.format("Lesser ", 3),
    "LGPL-2.1": GNU_HEADER.format("Lesser ", 2.1),
    "LGPL-2.0": GNU_HEADER.format("Library ", 2),
    "AGPL-3.0": GNU_HEADER.format("Affero ", 3),
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software "
    "Foundation",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software "
    "Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at",
}
# What counts only in texts without any of the above; of equal ones the first.
TITLES = {
    "Apache-2.0": "Apache License Version 2.0",
    "MIT": PERMISSION,
    "MIT-title": "MIT License",
    "BSD-2-Clause": REDISTRIBUTION,
    "GPL-3.0": "GNU General Public License version 3",
    "GPL-2.0": "GNU General Public License version 2",
    "LGPL-3.0": "GNU Lesser General Public License version 3",
    "AGPL-3.0": "GNU Affero General Public License version 3",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "ISC": "ISC License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSD-2-Clause-title": "BSD 2-Clause License",
    "BSD-4-Clause": "BSD 4-Clause License",
    "LGPL-2.1": "GNU Lesser General Public License version 2.1",
    "LGPL-2.0": "GNU Library General Public License version 2",
    "Apache-1.1": "Apache License Version 1.1",
    "BSL-1.0": "Boost Software License Version 1.0",
    "Zlib": "zlib License",
    "GPL-1.0-or-later": "GNU General Public License",  # without a version any may be chosen
}
# The names of families, and the words before a version.
FAMILIES = {
    "apache", "mit", "isc", "gnu", "lesser", "library", "affero", "mozilla", "bsd", "2-clause", "3-clause", "4-clause", "zlib",
    "boost", "eclipse", "cc", "by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd", "cc0", "attribution",
    "attribution-noncommercial", "attribution-sharealike", "attribution-noderivatives",
    "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives", "unencumbered",
}
GNU_KINDS = {"lesser", "library", "affero"}
BEFORE_VERSION = {"version", "v", "license"} | {f for f in FAMILIES if f.startswith(("by", "cc0", "attribution"))}
DENIALS = {"not", "never", "isn't", "aren't", "wasn't"}
GIVING = {"licensed", "released", "distributed", "covered", "governed", "available", "subject", "under"}
#: Words after a denial that it reaches.
DENIED = 8
SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*(\(*{SPDX_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{SPDX_ID}\)*)*)")
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z0-9]+)?$"
THRESHOLD = 0.75
FILE_SHARE = 0.3
EDGES = ".,;:()[]{}\"'<>*#/!"
BREAK = re.compile(r"[\x20\x09-\x0D]+")


def terms_of(text: str) -> list[str]:
    """Words in lower case without marks around them; ``v2.0`` is ``version 2.0``."""
    out = []
    for word in BREAK.split(text.lower()):
        if term := word.strip(EDGES):
            out += ["version", term[1:]] if term[0] == "v" and term[1:2].isdigit() else [term]
    return out


def mark(term: str) -> str:
    """A version without ``v`` before and zeros after it; any other word as it is."""
    number = re.fullmatch(r"v?([0-9]{1,2}(?:\.[0-9]+)*)", term)
    return re.sub(r"(\.0)+$", "", number.group(1)) if number else term


def marks_of(terms: list[str]) -> set[str]:
    """What tells a template from those of other licences: names of families, and versions."""
    versions = {mark(b) for a, b in zip(terms, terms[1:]) if a in BEFORE_VERSION and mark(b)[:1].isdigit() and len(mark(b)) < 4}
    return {t for t in terms if t in FAMILIES} | versions


def denied(terms: list[str]) -> np.ndarray:
    """Places of words that a denial reaches."""
    out = np.zeros(len(terms), bool)
    for i, t in enumerate(terms[:-1]):
        if t in DENIALS and terms[i + 1] in GIVING:
            out[i : i + 1 + DENIED] = True
    return out


def spdx_name(expression: str) -> str | None:
    """A stated licence without what says which versions it may be; null if none is stated."""
    ids = re.sub(rf"({SPDX_ID})", lambda m: re.sub(r"(-only|-or-later|\+)$", "", m.group(1)), expression)
    if " " not in ids:
        ids = ids.strip("()")
    return None if ids.upper() in ("NONE", "NOASSERTION") else ids


@dataclass
class Index:
    """Templates as sparse unit vectors, and the words of which a match must hold one."""

    names: list[str]
    vectors: list[dict[str, float]]
    idf: dict[str, float]
    unknown: float
    signs: list[str]
    own_signs: list[set[str]]  # of each template
    sizes: list[int]  # words
    full: int  # templates before TITLES
    marks: list[set[str]]  # that a passage must hold

    @classmethod
    def build(cls, frequencies: dict[str, int], files: int, threshold: float = THRESHOLD) -> Index:
        unknown = log(files + 1) + 1
        idf = {t: log((files + 1) / (n + 1)) + 1 for t, n in frequencies.items()}
        names, vectors, own_signs, sizes, marks = [], [], [], [], []
        for name, text in [*TEMPLATES.items(), *TEXTS.items(), *TITLES.items()]:
            terms = terms_of(text)
            weights = {t: n * idf.get(t, unknown) for t, n in Counter(terms).items()}
            norm = sqrt(sum(w * w for w in weights.values()))
            vector = {t: w / norm for t, w in weights.items()}
            names.append(re.sub("-(long|text|title|work)$", "", name))
            marks.append(marks_of(terms))
            vectors.append(vector)
            sizes.append(len(terms))
            left, signs = 1.0, set()  # the square of what the words not yet taken can reach
            for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if left < threshold**2:
                    break
                signs.add(term)
                left -= w * w
            own_signs.append(signs)
        every = sorted(set().union(*own_signs))
        return cls(names, vectors, idf, unknown, every, own_signs, sizes, len(TEMPLATES) + len(TEXTS), marks)

    def cosine(self, terms: list[str], place: int) -> float:
        """Of a passage and a template."""
        weights = {t: n * self.idf.get(t, self.unknown) for t, n in Counter(terms).items()}
        norm = sqrt(sum(w * w for w in weights.values())) or 1.0
        return sum(w * weights.get(t, 0.0) for t, w in self.vectors[place].items()) / norm

    def best(self, terms: list[str]) -> tuple[float, int]:
        """Best cosine of a passage and the place of its template."""
        scores = [self.cosine(terms, i) for i in range(len(self.vectors))]
        place = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return scores[place], place

    def told(self, terms: list[str], place: int) -> bool:
        """Whether a passage holds the marks of a template and none of another kind of GNU licence."""
        wanted, held = self.marks[place], {mark(t) for t in terms}
        return wanted <= held and ("gnu" not in wanted or not (held & GNU_KINDS) - wanted)

    def windows(self, terms: list[str], weights: np.ndarray, place: int) -> tuple[float, list[tuple[int, int]]]:
        """Best cosine of the windows about as long as a template, and all windows that match."""
        vector, size = self.vectors[place], self.sizes[place]
        square = np.concatenate([[0.0], np.cumsum(weights * weights)])
        dot = np.concatenate([[0.0], np.cumsum(weights * np.array([vector.get(t, 0.0) for t in terms]))])
        top, found, void = 0.0, [], denied(terms)
        step = 1 + size // 16
        for length in sorted({min(len(terms), size + k * step) for k in (-1, 0, 1, 2)} - {0}):
            # Repeated words only make the norm larger, so this is no less than the cosine.
            bound = (dot[length:] - dot[:-length]) / np.sqrt(square[length:] - square[:-length])
            for start in np.flatnonzero(bound >= THRESHOLD - 1e-9).tolist():
                passage = terms[start : start + length]
                score = self.cosine(passage, place)
                if score >= THRESHOLD and not void[start] and self.told(passage, place):
                    top = max(top, score)
                    found.append((start, start + length))
        return top, found

    def notice(self, text: str) -> tuple[str | None, float, int, int]:
        """Licence and score of the best passage, words in passages that match, words of the text."""
        low = text.lower()
        stated = SPDX.search(text) if "spdx-license" in low else None
        if not stated and not any(s in low for s in self.signs):
            return None, 0.0, 0, len(text.split())
        terms = terms_of(text)
        known, own = set(terms), None
        best, place, covered = 0.0, -1, np.zeros(len(terms) + 1, np.int64)
        for i in range(len(self.names)):
            if i == self.full and place >= 0:
                break
            if known.isdisjoint(self.own_signs[i]):
                continue
            if own is None:
                own = np.array([self.idf.get(t, self.unknown) for t in terms])
            score, found = self.windows(terms, own, i)
            for start, end in found:
                covered[start] += 1
                covered[end] -= 1
            if round(score, 9) > best:
                best, place = round(score, 9), i
        matched = int((np.cumsum(covered) > 0).sum())
        if stated and (name := spdx_name(stated.group(1))):
            return name, 1.0, max(matched, 2), len(terms)
        return (self.names[place] if place >= 0 else None), best, matched, len(terms)


def frequencies(text: DataFrame) -> dict[str, int]:
    """In how many of the texts each word of the templates occurs; at most as many rows as there are words."""
    texts = [*TEMPLATES.values(), *TEXTS.values(), *TITLES.values()]
    vocabulary = sorted({t for x in texts for t in terms_of(x)})
    place = {t: i for i, t in enumerate(vocabulary)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(place), np.int64)
        for batch in batches:
            for piece in pieces(whole_texts(batch.column(0))):
                words, doc = words_of(pc.utf8_lower(piece))
                coded = words.dictionary_encode()
                own = np.array([place.get(w.strip(EDGES), -1) for w in coded.dictionary.to_pylist()], np.int64)
                term = own[coded.indices.to_numpy()] if len(own) else own
                met = np.unique(doc[term >= 0].astype(np.int64) * len(place) + term[term >= 0])
                sums += np.bincount(met % len(place), minlength=len(place))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(place))), pa.array(sums)], ["term", "n"])

    rows = text.mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {vocabulary[r["term"]]: r["n"] for r in rows}


NOTICE = "struct<license: string, score: double, matched: bigint, words: bigint>"
ARROW_NOTICE = pa.struct(
    [("license", pa.string()), ("score", pa.float64()), ("matched", pa.int64()), ("words", pa.int64())]
)


def notices(text: Column, index: Index) -> Column:
    """The best notice of a text."""

    def found(texts: pa.Array) -> pa.Array:
        rows = [index.notice(t) for p in pieces(whole_texts(texts)) for t in p.to_pylist()]
        return pa.array([dict(zip(("license", "score", "matched", "words"), r)) for r in rows], ARROW_NOTICE)

    return F.arrow_udf(found, NOTICE).asNondeterministic()(text)


def directory(path: Column) -> Column:
    """The path up to its last slash; of a path without one, the empty directory above all."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """(depth, folder) of a directory and all above it, the empty one last."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    rooted = F.startswith(folder, F.lit("/"))
    return F.transform(
        F.sequence(F.size(parts), F.lit(0), F.lit(-1)),
        lambda n: F.struct(
            n.alias("depth"),
            F.concat(F.when(rooted & (n > 0), "/").otherwise(""), F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("folder"),
        ),
    )


def scan(files: DataFrame) -> DataFrame:
    """One row for each of ``files`` (doc_id, path, text): license, score, how it was found and where.

    ``how`` is header, file or inherited, or null without a licence; ``origin`` is the path of the file
    that states it.
    """
    bounded_batches(files.sparkSession)
    files = files.select("doc_id", "path", "text")
    index = Index.build(frequencies(files.select("text")), files.count())
    rows = files.select("doc_id", "path", notices(F.col("text"), index).alias("n")).select("doc_id", "path", "n.*")
    whole = F.col("path").rlike(LICENSE_FILE) | (F.col("matched") >= FILE_SHARE * F.col("words"))
    speaks = F.col("license").isNotNull() & F.coalesce(whole, F.lit(False))
    rows = rows.withColumns({"folder": directory(F.col("path")), "speaks": speaks})
    rows = stage(rows.drop("matched", "words"), "notices")

    # The best licence file of each directory: a small struct a file, combined before the shuffle.
    rank = F.struct((-F.col("score")).alias("worse"), "path", "license")
    stated = rows.filter("speaks and path is not null").groupBy("folder").agg(F.min(rank).alias("best"))
    stated = stage(stated.select("folder", "best.license", "best.path"), "stated")
    asking = rows.filter("license is null and folder is not null").select("folder").distinct()
    above = asking.select(F.col("folder").alias("own"), F.explode(ancestors(F.col("folder"))).alias("a"))
    met = above.select("own", "a.*").join(maybe_broadcast(stated), "folder")
    nearest = met.groupBy("own").agg(F.max(F.struct("depth", "license", "path")).alias("near"))
    nearest = stage(nearest.select(F.col("own").alias("folder"), "near.license", "near.path"), "nearest")
    given = nearest.withColumnsRenamed({"license": "given", "path": "giver"})
    out = rows.join(maybe_broadcast(given), "folder", "left")
    own = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path",
        F.when(own, F.col("license")).otherwise(F.col("given")).alias("license"),
        F.when(own, F.col("score")).alias("score"),
        F.when(own & F.col("speaks"), "file").when(own, "header").when(F.col("given").isNotNull(), "inherited").alias("how"),
        F.when(own, F.col("path")).otherwise(F.col("giver")).alias("origin"),
    )

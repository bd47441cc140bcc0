import re

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import licenses as L

from .conftest import ODD_TEXTS

COLUMNS = "doc_id bigint, path string, text string"
MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
PROSE = "Some prose that goes on for a while and says nothing of terms at all.\n" * 4


@pytest.fixture
def files_of(spark):
    return lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


def found(files):
    return [tuple(r)[2:] for r in L.scan(files).orderBy("doc_id").collect()]


def test_own_and_inherited(files_of):
    files = files_of([
        ("r/LICENSE", MIT), ("r/a/x.py", PROSE), ("r/a/b/COPYING", PROSE + APACHE), ("r/a/b/c/y.py", PROSE),
        ("r/a/b/c/z.py", APACHE + "\n" + PROSE), ("s/x.py", PROSE), (None, PROSE), ("r/e.py", None),
        ("/t/LICENSE.txt", MIT), ("/t/u/v", ""), ("top", PROSE), ("rr/x", PROSE), (None, MIT),
    ])
    got = found(files)
    how = [(r[0], r[2], r[3]) for r in got]
    assert how == [
        ("MIT", "file", "r/LICENSE"), ("MIT", "inherited", "r/LICENSE"), ("Apache-2.0", "file", "r/a/b/COPYING"),
        ("Apache-2.0", "inherited", "r/a/b/COPYING"), ("Apache-2.0", "header", "r/a/b/c/z.py"),
        (None, None, None), (None, None, None), ("MIT", "inherited", "r/LICENSE"),
        ("MIT", "file", "/t/LICENSE.txt"), ("MIT", "inherited", "/t/LICENSE.txt"), (None, None, None),
        (None, None, None), ("MIT", "file", None),
    ]
    assert all(r[1] >= L.THRESHOLD for r in got if r[1] is not None)


def test_a_file_above_all(files_of):
    assert [r[0] for r in found(files_of([("LICENSE", MIT), ("a/b/c", PROSE), ("x", PROSE)]))] == ["MIT"] * 3


def test_ties(files_of):
    files = files_of([("d/LICENSE.b", MIT), ("d/LICENSE.a", APACHE), ("d/LICENSE.a", APACHE), ("d/x", PROSE)])
    assert found(files)[3][3] == "d/LICENSE.a"


def test_signs_lose_nothing():
    index = L.Index.build({t: 5 for x in L.TEMPLATES.values() for t in L.terms_of(x)}, 100)
    for name, text in L.TEMPLATES.items():
        assert index.notice(f"prose\n{text}.\nmore")[0] == re.sub("-(long|work)$", "", name)
        long = PROSE.replace("\n", " ") + text + " " + PROSE.replace("\n", " ")
        assert any(s in long.lower() for s in index.signs)
    for text in [PROSE, *[t for t in ODD_TEXTS if t]]:
        scores = [index.best(L.terms_of(line))[0] for line in text.split("\n")[:50]]
        assert max(scores) < L.THRESHOLD and index.notice(text)[0] is None


def test_frequencies_and_documents(spark, files_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = L.frequencies(docs.select("text"))
    for term in ("license", "the", "gnu", "2.0", "by"):
        assert got[term] == sum(term in L.terms_of(t) for t in texts.values()), term
    rows = L.scan(docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))).collect()
    own = {r["doc_id"]: r["license"] for r in rows if r["how"] in ("file", "header")}
    said = {i for i, t in texts.items() if re.search("(?i)licensed under|MIT License|all rights reserved", t)}
    assert set(own) == said and len(rows) == len(texts)


def test_odd_rows(files_of):
    files = files_of([(f"a/{i}", t) for i, t in enumerate(ODD_TEXTS)]).withColumn("license", F.lit("x"))
    assert len(found(files)) == len(ODD_TEXTS)
    assert L.scan(files.limit(0)).count() == 0


APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at"
)
GNU = (
    "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General "
    "Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n"
    "# (at your option) any later version.\n"
)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        (APACHE_HEADER, "Apache-2.0"),
        ("Copyright (c) 2020 Jane Doe. Released under the MIT License", "MIT"),
        ("MIT License", "MIT"),
        ("The MIT License (MIT)\n\nCopyright (c) 2020 Jane", "MIT"),
        ("GNU GENERAL PUBLIC LICENSE", "GPL-1.0-or-later"),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "GPL-3.0"),
        (L.TEXTS["MIT"], "MIT"),
        ("// SPDX-License-Identifier: MPL-2.0\nint x;", "MPL-2.0"),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        (GNU, "GPL-3.0"),
        (L.REDISTRIBUTION + ": 1. " + PROSE + "Neither the name of Jane nor the names of its contributors may be used to "
         "endorse or promote products derived from this software without specific prior written permission.",
         "BSD-3-Clause"),
        (L.REDISTRIBUTION, "BSD-2-Clause"),
    ],
)
def test_notices_among_other_words_and_headers(spark, text, name):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    if not INDEX:
        INDEX.append(L.Index.build(L.frequencies(docs.select("text")), docs.count()))
    assert INDEX[0].notice(text)[0] == name
    assert INDEX[0].notice(PROSE + text + "\n" + PROSE)[0] == name


INDEX = []


def test_templates_in_long_lines_and_over_two():
    index = L.Index.build({t: 5 for x in L.TEMPLATES.values() for t in L.terms_of(x)}, 100)
    prose = PROSE.replace("\n", " ")
    for name, text in L.TEMPLATES.items():
        words = text.split()
        for shown in (text, " ".join(words[:2]) + "\n" + " ".join(words[2:])):
            assert index.notice(prose + shown + " " + prose)[0] == re.sub("-(long|work)$", "", name), name


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
        ("Licensed under the Apache License v2.0", "Apache-2.0"),
        ("Licensed under CC BY 3.0", "CC-BY-3.0"), ("Licensed under CC BY 2.5", None),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
        ("Use of this source code is governed by a BSD 4-clause license", "BSD-4-Clause"),
        ("Released under the Zlib License", "Zlib"), ("Released under the Foo License", None),
        ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        ("Licensed under the GNU Library General Public License version 2", "LGPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
        ("Licensed under the GNU General Public License version 3.0", "GPL-3.0"),
        ("Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
        (L.GNU_HEADER.format("Lesser ", 2.1), "LGPL-2.1"), (L.GNU_HEADER.format("", 2), "GPL-2.0"),
        ("This project is not released under the MIT License", None),
        ("You may not remove this. Released under the MIT License", "MIT"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "(MIT OR Apache-2.0)"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0 WITH Classpath-exception-2.0"),
        ("// SPDX-License-Identifier: NONE", None), ("// SPDX-License-Identifier: (MIT)", "MIT"),
    ],
)
def test_neighbouring_licences(spark, text, name):
    if not INDEX:
        docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        INDEX.append(L.Index.build(L.frequencies(docs.select("text")), docs.count()))
    assert INDEX[0].notice(text)[0] == name
    assert INDEX[0].notice(PROSE + text + "\n" + PROSE)[0] == name


def test_against_a_plain_cosine_of_all_windows():
    """Every window of every template's lengths, weighed one by one."""
    import random
    from collections import Counter
    from math import sqrt

    index = L.Index.build({t: 5 for x in L.TEMPLATES.values() for t in L.terms_of(x)}, 100)
    all_texts = [*L.TEMPLATES.values(), *L.TEXTS.values(), *L.TITLES.values()]

    def plain(text):
        terms = L.terms_of(text)
        best = (0.0, None)
        for place, template in enumerate(all_texts):
            if place == len(L.TEMPLATES) + len(L.TEXTS) and best[1]:
                break
            own = L.terms_of(template)
            t = {w: n * index.idf.get(w, index.unknown) for w, n in Counter(own).items()}
            step = 1 + len(own) // 16
            for length in {min(len(terms), len(own) + k * step) for k in (-1, 0, 1, 2)} - {0}:
                for start in range(len(terms) - length + 1):
                    window = terms[start:start + length]
                    v = {w: n * index.idf.get(w, index.unknown) for w, n in Counter(window).items()}
                    dot = sum(x * v.get(w, 0.0) for w, x in t.items())
                    norms = sqrt(sum(x * x for x in t.values())) * sqrt(sum(x * x for x in v.values()))
                    score = round(dot / norms, 9)
                    if dot / norms >= L.THRESHOLD and score > best[0] and not L.denied(terms)[start] and index.told(window, place):
                        best = (score, index.names[place])
        return best

    draw = random.Random(8)
    words = [w for t in all_texts[:20] for w in t.split()] + "some other plain words here".split()
    for _ in range(12):
        template = draw.choice(all_texts).split()
        text = [draw.choice(words) for _ in range(draw.randint(0, 12))] + template + [draw.choice(words) for _ in range(draw.randint(0, 12))]
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(len(text))] = draw.choice(words)
        got = index.notice(" ".join(text))
        assert (got[1], got[0]) == plain(" ".join(text)), " ".join(text)

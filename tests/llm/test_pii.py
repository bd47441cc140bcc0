import hashlib
import random
import re

import pytest

from parcelflow.llm import pii

from .conftest import ODD_TEXTS

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][int(c)] for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_plain_ones_as_the_patterns_say():
    draw = random.Random(3)
    parts = ["a@b.c", "x.y+z@h-1.co.uk", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111 ",
             "+1 (415) 555-0100", "+", "@", ".", "_", " ", "-", "0", "7", "é", "\n", "4111-1111-1111-1111",
             "378282246310005", "a", "0001.0.0.1", "..", "+1"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert pii.identifiers(text) == plain(text), text


@pytest.mark.parametrize("text, kind, shown", [
    ("mail jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
    ("mail jane at example dot com now", "email", "jane at example dot com"),
    ("jane(at)example.com", "email", "jane(at)example.com"),
    ("jane dot doe (at) mail (dot) example (dot) org!", "email", "jane dot doe (at) mail (dot) example (dot) org"),
    ("to jаne@exаmple.com", "email", "jаne@exаmple.com"),  # Cyrillic а
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("call plus one four one five five five five zero one zero zero ok", "phone",
     "plus one four one five five five five zero one zero zero"),
    ("card ４１１１ 1111 1111 1111 é", "card", "４１１１ 1111 1111 1111"),
    ("host one nine two dot one six eight dot 0 dot 1 up", "ip", "one nine two dot one six eight dot 0 dot 1"),
    ("ip 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
    ("ja​ne@example.com", "email", "ja​ne@example.com"),
])
def test_disguises(text, kind, shown):
    found = pii.spans(text)
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in found if not s["plain"]] == [(kind, shown)]


@pytest.mark.parametrize("text", [
    "we look at the dot on it", "seven of nine at ten", "meet at example.com", "one two three four",
    "а б в г", "anat at thon. dot", "at dot at dot",
])
def test_prose_is_left_alone(text):
    assert pii.spans(text) == []


def test_query_columns_and_odd_rows(spark, docs_of):
    texts = [*ODD_TEXTS, "é a@b.c at 1.2.3.4", "1" * 200_000, "a" * 200_000 + "@", "+" * 50_000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = pii.digests(pii.scan(docs_of(texts))).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        want = plain(text or "") if len(text or "") < 150_000 else []
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(listed.split(",")) <= set(row["spans"].split(",")) or not listed
    assert pii.scan(docs_of([])).count() == 0


def test_mask(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of(["a@b.c and jane (at) x.org", None, "x"])
    masked = docs.select("doc_id", pii.mask(F.col("text"), pii.find(F.col("text"))).alias("m"))
    assert [r["m"] for r in masked.orderBy("doc_id").collect()] == ["<email> and <email>", None, "x"]


@pytest.mark.parametrize(
    "shown",
    [
        "jane@example[dot]com", "jane@example dot com", "jane@example (dot) org", "jane at mail.example dot com",
        "jane at example dot se", "jane@mail.example[.]museum", "jane@mail dot example dot co dot uk",
    ],
)
def test_dots_disguised_by_themselves(shown):
    text = f"write to {shown}, or call"
    found = [(s["kind"], text[s["start"] : s["end"]]) for s in pii.spans(text)]
    assert ("email", shown) in found


@pytest.mark.parametrize("text", ["look at the dot on it", "see a@b dot the rest", "meet at noon. dot it", "@all dot com"])
def test_dots_in_prose(text):
    assert pii.spans(text) == []

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import secret_scan as S
from parcelflow.llm.common import span_digests

from .conftest import ODD_TEXTS


def brute(text, rules=S.RULES):
    found = []
    for i, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), i, m.end()))
    return [(rules[i].kind, s, e, i < 3) for s, i, e in sorted(found)]


def test_queries_of_expressions():
    q = lambda p: sorted(map(sorted, S.trigram_query(p)))
    assert q("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert q("abcd|ab") == [[]] == q("[0-9a-f]+") == q("(abc)*") == q("ab.cd")
    assert q("(abc)+x") == [["abc"]]
    assert q("gh[pq]_[a-z]+") == [["ghp", "hp_"], ["ghq", "hq_"]]
    assert q("(?i:Key)(one|two)") == [
        ["eyo", "key", "one", "yon"], ["eyt", "key", "two", "ytw"]
    ]
    assert q("a{3}b?") == [["aaa"]]


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.kind)
def test_every_match_holds_its_query(rule):
    made = {
        "assign": ["PassWord = 'abcdefgh12", "api_key:x1234567", "ApiKey=12345678", "tOken==12345678", "passwd='a.b.c.d.e'"],
        "access": ["AKIA123456789012"], "hex": ["0" * 32], "github": ["ghp_" + "a" * 36],
        "slack": ["xoxb-1234567890"], "google": ["AIza" + "b" * 35], "stripe": ["sk_live_" + "c" * 16],
        "jwt": ["eyJhbGciOi1.eyJzdWIiOi1.sig"], "private_key": ["-----BEGIN RSA PRIVATE KEY-----"],
        "url_password": ["https://me:secret1@host"],
    }[rule.kind]
    for text in made:
        assert re.search(rule.pattern, text)
        low = text.lower()
        query = S.trigram_query(rule.pattern)
        assert any(all(g in low for g in s) for s in query), text


def test_against_brute_force(spark, docs_of):
    draw = random.Random(9)
    parts = ["password", "PASSWD", "secret", "toKen", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef12", "é",
             "\U0001f600", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "ghp_", "a" * 36, "xoxb-", "1234567890",
             "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "https://", "me:pw@", "\n", "eyJabcdefgh.", "sk_live_", "==", "/+"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    texts += [*ODD_TEXTS, "f" * 300_000, "deadbeef" * 4 + " " + "AKIA" * 50, "token" + " " * 50_000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = S.scan(docs_of(texts))
    rows = found.select("*", *[c for c in span_digests(F.col("spans"), ("assign", "access", "hex"))[:4]])
    rows = rows.orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        want = brute(text)
        assert [tuple(s) for s in row[1]] == want, text[:300]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e, plain in want if plain)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["n_assign"] == sum(k == "assign" for k, *_ in want)


def test_repeated_rows_null_ids_and_empty(docs_of):
    docs = docs_of([(None, "token=abcdefgh"), (None, None), (4, "token=abcdefgh"), (4, "token=abcdefgh")])
    docs = docs.withColumn("key", F.lit(1)).withColumn("rules", F.lit(2))
    rows = S.scan(docs).collect()
    assert sorted(len(r["spans"]) for r in rows) == [0, 1, 1, 1]
    assert S.scan(docs.limit(0)).count() == 0

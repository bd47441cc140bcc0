import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import text as T


def apply(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", function(F.col("t")).alias("out")).collect()
    return [r["out"] for r in sorted(found, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "function, given, expected",
    [
        (T.redact_phones, "call 555 1234 now", "call[REDACTED_PHONE] now"),
        (T.scrub_pii, "ref 123456", "ref[REDACTED_PHONE]"),
        (T.scrub_pii, "order 12345 ok", "order 12345 ok"),
        (T.scrub_pii, "to a.b@c.org at https://x.y/z ^AB @me", "to [REDACTED_EMAIL] at   "),
        (T.redact_emails, "éa.b@c.orgé x@y.io", "éa.b@c.orgé [REDACTED_EMAIL]"),
        (lambda c: T.alias_carriers(c, ["ups"], "Shipping_A"), "x ups, upset UPS",
         "x Shipping_A, upset Shipping_A"),
        (lambda c: T.alias_carriers(c, [], "Shipping_A"), "with SHIPPING_a2", "with Shipping_A2"),
        (T.normalize_text, " Ｆｕｌｌ　width\n\x1cﬁ  ", "Full width fi"),
        (T.normalize_text, None, ""),
        (T.dedup_key, "Straße--GRÜN!  ½", "strasse grün ½"),
        (T.ascii_safe, "a–b—c−d→e←f’g‘h“i”j…k l", "a-b-c-d->e<-f'g'h\"i\"j...k l"),
        (lambda c: T.enforce_max_tokens(c, 2), "é" * 20, "é" * 8),
        (lambda c: T.detwitterize_agent(c, False), "pls look #tag thx @us DM us now",
         "please look thanks"),
        (lambda c: T.detwitterize_agent(c, False), "admin Direct message us", "admin"),
        (lambda c: T.detwitterize_agent(c, True), "ok", T.STEP_TEMPLATE + "ok"),
        (lambda c: T.detwitterize_agent(c, True), "", T.STEP_TEMPLATE.strip()),
        (lambda c: T.detwitterize_agent(c, True), "x Here’s what I’ll do: y", "x Here’s what I’ll do: y"),
        (lambda c: T.contains_any(c, ["TRACK", "a+b"]), "off Track", True),
        (lambda c: T.contains_any(c, ["track", "a+b"]), "aab", False),
        (lambda c: T.contains_any(c, ["track"]), None, False),
        (lambda c: T.contains_any(c, []), "x", False),
    ],
)
def test_golden(spark, function, given, expected):
    assert apply(spark, function, [given]) == [expected]


def test_normalize_matches_unicode_rules(spark):
    rng = random.Random(3)
    pieces = ["é", "é", "ﬃ", "Ａ", "①", "…", " ", " ", "\x1d", "x", "\n", "ｶﾞ"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(500)]
    expected = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip() for t in texts]
    assert apply(spark, T.normalize_text, texts) == expected


def test_multi_word_names_that_share_words_keep_their_order(spark):
    def fold(c):
        return T.alias_carriers(c, ["mail b", "a mail"], "Z")

    assert apply(spark, fold, ["a mail b"]) == ["a Z"]


def test_scrubbed_text_has_no_address_and_no_long_number(spark):
    rng = random.Random(5)
    pieces = ["a.b@c.org", "12345678", "555", " ", "-", "x", "+49 170 1234567", "(0)", "@"]
    texts = ["".join(rng.choices(pieces, k=12)) for _ in range(300)]
    for out in apply(spark, T.scrub_pii, texts):
        assert not re.search(r"\b[\w.]+@[\w.]+\.\w{2,}\b", out) and not re.search(r"\d{6}", out)

"""Long lists of phrases: the automaton against chains of plain expressions."""

import random

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import guard as G, phrases as P, text as T

WORDS = ["dhl", "UPS", "royal mail", "royal", "mail express", "express", "İst", "straße", "ſea", "k", "a b", "b a", "x-y", "ups dhl ups"]


def texts(seed, n=300):
    draw = random.Random(seed)
    parts = [*WORDS, "DHL", "Royal  Mail", "ROYAL MAIL EXPRESS", "STRASSE", "Straße", "\u212a", "sea", "_dhl", "dhl2", "dhl.", "a a b a", "é", "-", ","]
    return [*(draw.choice([" ", "", "-"]).join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(n)), "", None]


def outcome(spark, column, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return {r["i"]: r["o"] for r in df.select("i", column.alias("o")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_long_lists_give_what_short_ones_give(spark, monkeypatch, seed):
    draw = random.Random(seed)
    names = draw.sample(WORDS, len(WORDS)) + ["dhl", "zzz"]
    rows = texts(seed)
    columns = {
        "alias": lambda: T.alias_carriers(F.col("t"), names, "Shipping_A"),
        "any": lambda: T.contains_any(F.col("t"), names),
        "listed": lambda: G.blocked_patterns(F.col("t"), names),
    }
    short = {k: outcome(spark, c(), rows) for k, c in columns.items()}
    for module in (T, G):
        monkeypatch.setattr(module, "MANY", 0)
    assert {k: outcome(spark, c(), rows) for k, c in columns.items()} == short


def test_ten_thousand_phrases_in_one_pass(spark):
    phrases = [f"p{i}" for i in range(10_000)]
    rows = ["p1 p9999 p10", "P77", "nothing", None, "xp500x"]
    assert outcome(spark, P.ranks_of(F.col("t"), phrases), rows)[0] == [1, 9, 10, 99, 999, 9999]
    assert outcome(spark, T.contains_any(F.col("t"), phrases), rows) == {0: True, 1: True, 2: False, 3: False, 4: True}
    assert outcome(spark, T.alias_carriers(F.col("t"), phrases, "c"), rows) == {0: "c c c", 1: "c", 2: "nothing", 3: None, 4: "xp500x"}


def test_empty_lists_and_phrases(spark):
    rows = ["abc", "", None]
    assert outcome(spark, P.holds_any(F.col("t"), []), rows) == {0: False, 1: False, 2: False}
    assert outcome(spark, P.holds_any(F.col("t"), [""]), rows) == {0: True, 1: True, 2: False}
    assert outcome(spark, P.phrases_of(F.col("t"), ["b", "", "b"]), rows) == {0: ["b", "", "b"], 1: [""], 2: []}
    assert outcome(spark, P.replace_words(F.col("t"), [], "x"), rows) == {0: "abc", 1: "", 2: None}

import re

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import decontaminate as D

from .conftest import ODD_TEXTS

ITEM = (
    "On the first day the baker called Tom sold 25 kg of fresh bread and on the second day he sold 40 kg, "
    "so how much bread did the baker called Tom sell in all these days together"
)
OTHER = ITEM.replace("Tom", "Anna").replace("25", "31").replace("40", "12")
MIXED = ITEM.replace("called Tom sold", "called Anna sold").replace("25", "31")


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(
        [(1, ITEM), (2, "too short to tell"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13")],
        "item_id bigint, text string",
    )


def found(docs, benchmark):
    return {(r["doc_id"], r["item_id"]): r["verbatim"] for r in D.contaminated(docs, benchmark).collect()}


def test_verbatim_and_new_values(docs_of, benchmark):
    prose = "some words that come before, and "
    docs = docs_of([
        prose + ITEM + " and after", OTHER, MIXED, prose, ITEM[:40], None, "", (None, OTHER), ITEM.upper(),
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14", (9, ITEM), (9, prose),
    ])
    assert found(docs, benchmark) == {(0, 1): True, (1, 1): False, (None, 1): False, (8, 1): True, (9, 1): True}
    kept = [(r["doc_id"], r["text"]) for r in D.clean(docs, benchmark).collect()]
    assert sorted(k[0] for k in kept) == [2, 3, 4, 5, 6, 9, 9] and (9, prose) in kept


def test_same_places_with_and_without_values(docs_of):
    docs = docs_of([*ODD_TEXTS, OTHER, "x5y 7.5KM, to Rome; Rome 3m 4 min. \x01d \x02", "é Ünder 12%"])
    rows = docs.select(D.template(F.col("text")).alias("a"), D.template(F.col("text"), True).alias("b")).collect()
    for r in rows:
        if r["a"] is not None:
            bare = [re.sub("\x02.*", "", w, flags=re.S) for w in r["b"]]
            assert bare == r["a"] or "\x02" in "".join(r["a"])


def test_odd_tables(spark, docs_of, benchmark):
    docs = docs_of(ODD_TEXTS).withColumn("words", F.lit(1)).withColumn("text_key", F.lit(2))
    assert D.contaminated(docs, benchmark).count() == 0
    assert D.clean(docs, benchmark).columns == docs.columns
    assert D.clean(docs, benchmark.limit(0)).count() == len(ODD_TEXTS)
    assert D.contaminated(docs.limit(0), benchmark).count() == 0


def test_documents_against_plain_search(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {k[0] for k in found(docs, items)}
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    asked = [norm(r["text"]) for r in items.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(a in norm(r["text"]) for a in asked)}
    assert want and got == want


EGGS = "There are 12 eggs in the basket that Maria carries; how many are left after breakfast?"
FIELD = "A farmer sells 3 sacks of corn and 40 bags of wheat in one long week, how many in all"


def test_case_line_breaks_and_forms_of_numbers(spark, docs_of):
    benchmark = spark.createDataFrame([(1, EGGS), (2, FIELD)], "item_id bigint, text string")
    docs = docs_of([
        EGGS, EGGS.lower(), EGGS.upper(), EGGS.replace(" Maria", "\nMaria"), EGGS.replace(" Maria", " \r\n  Maria"),
        FIELD.replace(" 3 ", " 2.50 ").replace("40", "1,200"), FIELD.replace(" 3 ", " 7 "),
        EGGS.replace("Maria", "Paula").replace("12", "1,012.5"),
    ])
    assert found(docs, benchmark) == {
        **{(i, 1): True for i in range(5)}, (5, 2): False, (6, 2): False, (7, 1): False
    }


def test_names_of_items_in_lower_case(spark, docs_of):
    benchmark = spark.createDataFrame([(1, EGGS.lower())], "item_id bigint, text string")
    assert found(docs_of([EGGS]), benchmark) == {(0, 1): True}


def test_items_shorter_than_a_window(spark, docs_of):
    items = ["What is the capital city of France?", "Add 5 and 7 in your head", "too short to tell", "1 2 3 4 5 6 7"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = docs_of([
        "He asked: What is the capital city of France? Nobody knew.", "what is the CAPITAL city of\nfrance",
        "What is the capital city of Spain?", "What is the large city of France?", "Now add 5 and 7 in your head, please",
        "Add 8 and 9 in your head", "it is too short to tell", "1 2 3 4 5 6 7", "What is the capital city", None,
    ])
    assert found(docs, benchmark) == {(0, 0): True, (1, 0): True, (2, 0): False, (4, 1): True, (5, 1): False}
    assert [r["doc_id"] for r in D.clean(docs, benchmark).orderBy("doc_id").collect()] == [3, 6, 7, 8, 9]

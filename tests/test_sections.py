"""Chunks by heading: the bodies are the file again, stacks of headings, whole questions, sizes."""

import random

import pytest
from pyspark.sql import functions as F

from parcelflow.operators.sections import chunk_sections

FILE = """Preamble line.

# Guide
Intro.

## Facts
First paragraph
of two lines.

Second paragraph.
### Detail
Deep.

## Questions
### Q: How long?
**A:** Three days.

But more in winter.

### Q: How much?
**A:** Eight.
#not a heading
# Other
End"""


def chunks_of(spark, texts, size):
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = chunk_sections(docs, ["n"], size=size).withColumn("i", F.col("chunk_id").cast("int")).orderBy("n", "i").collect()
    out = {n: [r for r in rows if r["n"] == n] for n in range(len(texts))}
    for n, text in enumerate(texts):
        assert "".join(r["body"] for r in out[n]) == (text or "")
        assert [r["i"] for r in out[n]] == list(range(len(out[n])))
    return out


def test_headings_and_questions(spark):
    rows = chunks_of(spark, [FILE], 60)[0]
    assert [(r["headings"], r["body"].split("\n")[0]) for r in rows] == [
        ([], "Preamble line."), (["Guide"], "# Guide"), (["Guide", "Facts"], "## Facts"),
        (["Guide", "Facts", "Detail"], "### Detail"), (["Guide", "Questions"], "## Questions"),
        (["Guide", "Questions", "Q: How long?"], "### Q: How long?"), (["Guide", "Questions", "Q: How much?"], "### Q: How much?"),
        (["Other"], "# Other"),
    ]
    assert rows[5]["body"].count("\n") == 5 and len(rows[5]["body"]) <= 60
    assert rows[5]["text"].startswith("Guide > Questions > Q: How long?\n### Q: How long?")
    assert all(len(r["body"]) <= 60 for r in rows)


def test_a_question_is_never_cut_and_a_paragraph_is(spark):
    texts = ["## Q: Why?\n" + "because " * 50, "word " * 50, "", None, "\n\n\n", "# Only", "a\r\n# T \r\nb\x85c"]
    out = chunks_of(spark, texts, 40)
    assert len(out[0]) == 1 and {len(r["body"]) for r in out[1]} == {40, 10}
    assert out[2] == out[3] == [] and [r["text"] for r in out[4]] == [""] and out[6][-1]["headings"] == ["T"]


@pytest.mark.parametrize("size", [1, 25, 300])
def test_random_files_come_back(spark, size):
    draw = random.Random(size)
    parts = ["# A", "## B c", "### Q: d?", "###### deep", "", "", "text of a line", "é\U0001f600 " * 9, "####### seven", " # indented", "\t"]
    texts = ["\n".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for _ in range(30)]
    for n, rows in chunks_of(spark, texts, size).items():
        assert all(len(r["body"]) <= max(size, 0) or "Q: d?" in r["body"] or r["headings"][-1:] == ["Q: d?"] for r in rows)

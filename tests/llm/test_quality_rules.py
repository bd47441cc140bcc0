import re
from collections import Counter

from pyspark.sql import functions as F

from parcelflow.llm import quality_rules as Q

from .conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(inside), n < 50 or 100 * len(inside) > 50 * n,
    )


def test_against_brute_force(spark, docs_of):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = ODD_TEXTS + texts
    got = Q.ledger(docs_of(texts)).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        assert tuple(row[k] for k in [*Q.MEASUREMENTS[:5], "base_failed"]) == brute(text), text
        assert not (row["base_failed"] and row["kept"])


def test_clashing_columns_and_null_ids(docs_of):
    good = " ".join(f"word{i}" for i in range(60))
    docs = docs_of([(None, good), (None, None), (7, good), (7, good)])
    docs = docs.withColumn("ledger", F.lit(1)).withColumn("LEDGER_", F.lit(2)).withColumn("fail_bits", F.lit(3))
    kept = Q.judge(docs)
    assert kept.columns == docs.columns
    assert [r["text"] for r in kept.collect()] == [good] * 3
    assert Q.judge(docs.limit(0)).count() == 0 == Q.ledger(docs.limit(0)).count()


def test_ablations(docs_of):
    good = " ".join(f"word{i}" for i in range(60))
    rows = Q.ledger(docs_of([good, "few words", good + " #" * 30, "#" * 9]))
    found = {r["rule"]: (r["fails"], r["kept"], r["kept_without"]) for r in Q.ablations(rows).collect()}
    assert found["too_few_words"] == (2, 1, 2)
    assert found["symbols"] == (2, 1, 2)
    assert found["duplicate_lines"] == (0, 1, 1)

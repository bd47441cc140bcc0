"""Every stage against a brute-force version of it, each on its own input."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from parcelflow.llm import line_dedup
from parcelflow.llm.settings import TOKENIZERS

from .test_line_dedup import distance
from .test_minhash import shingles
from .test_quality_rules import brute as base_measures

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """What each stage is given and returns, over the documents with a few planted ones."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = [r for r in docs.orderBy("doc_id").limit(300).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = [" ".join(f"plain{k}word{i}" for i in range(80)) for k in range(5)]
    near = clean[0].split()
    near[40] = "changed"
    planted = [*clean, " ".join(near), clean[1], "Before it. " + clean[2].replace("2", "9") + " " + item, None, ""]
    rows = [*[tuple(r) for r in first], *[(100_000 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(planted)]]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/in")
    given, out = spark.read.parquet(f"{folder}/in"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, SF).write.parquet(f"{folder}/{name}")
        result = spark.read.parquet(f"{folder}/{name}")
        out.append((name, given, result))
        given = result
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(passed):
    for _, given, result in passed[:-1]:
        assert result.dtypes == given.dtypes


def test_quality(passed):
    _, given, result = passed[0]
    before, after = texts(given), texts(result)
    assert all(after[i] == before[i] for i in after)
    assert not any(base_measures(t)[-1] for t in after.values())
    junk = lambda t: base_measures(t)[-1] or t.count("|") > 50 or t.count("%%%") > 20
    assert {i for i, t in before.items() if not junk(t)} - set(after) <= {
        i for i, t in before.items() if re.search(r"[#*$%&|<>]|!!", t or "")
    }
    assert {100_000 + i for i in range(8)} <= set(after)


def test_lines(passed):
    _, given, result = passed[1]
    after, seen = texts(result), []
    by_length = {}
    for i, text in sorted(texts(given).items()):
        kept = []
        for line in text.split("\n"):
            if len(line) >= line_dedup.MIN_CHARS:
                near = [x for n in range(-2, 3) for x in by_length.get(len(line) + n, ())]
                repeated = any(x == line or (x[:8] == line[:8] or x[-8:] == line[-8:]) and distance(x, line) <= 2 for x in near)
                by_length.setdefault(len(line), []).append(line)
                if repeated:
                    continue
            kept.append(line)
        left = "\n".join(kept)
        if len(left.strip(" ")) >= line_dedup.LEAST_LEFT * len(text) or left == text:
            seen.append((i, left))
    assert after == dict(seen)
    assert 100_006 not in after  # all of its lines came before


def test_near_duplicates(passed):
    _, given, result = passed[2]
    before, after = texts(given), texts(result)
    sets = {i: shingles(t, 5) for i, t in before.items()}
    top = {i: i for i in before}
    ids = sorted(before)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top[i], top[j]))
                for k in top:
                    top[k] = a if top[k] == b else top[k]
    assert set(after) == set(top.values()) and all(after[i] == before[i] for i in after)
    assert 100_005 not in after and 100_000 in after


def test_benchmark(spark, passed):
    _, given, result = passed[3]
    before, after = texts(given), texts(result)
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    asked = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in before.items() if any(a in norm(t) for a in asked)}
    assert 100_007 in leaks and leaks == set(before) - set(after)


def test_encoding(passed):
    _, given, result = passed[4]
    library = Library.from_file(TOKENIZERS["word_bpe_49k"])
    rows = {r["doc_id"]: r for r in result.collect()}
    before = texts(given)
    assert set(rows) == set(before)
    for i, text in before.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == ids
        assert rows[i]["ids_sha256"] == hashlib.sha256(bytes(rows[i]["ids"])).hexdigest()


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 50 and "ids_sha256" in rows.columns


def test_odd_tables(spark, docs_of, tmp_path):
    """Repeated and missing ids, very long texts, clashing columns and no rows, through all stages."""
    from pyspark.sql import functions as F

    def clean(k):
        return "\n".join(" ".join(f"clean{k}word{i}" for i in range(n, n + 40)) for n in (0, 40))

    long = "\n".join(" ".join(f"long{n}word{i}" for i in range(50)) for n in range(2000))
    rows = [(1, clean(1)), (1, clean(2)), (1, clean(2)), (None, clean(3)), (7, clean(1)), (7, clean(4)), (8, long), (9, None), (10, "")]
    extra = ["id", "n", "line", "place", "window", "found_text", "gone_id", "text_key", "held", "part", "component", "kept"]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in extra})
    for name, given in (("odd", docs), ("none", docs.limit(0))):
        for step, (stage, run) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{step}"
            run(spark, given, SF).write.parquet(path)
            out = spark.read.parquet(path)
            if step < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == given.dtypes, stage
                given = out
        kept = sorted(((r["doc_id"], r["text"]) for r in given.collect()), key=repr)
        if name == "odd":
            # The second of equal rows and the copy of a clean text are repeats; all else stays.
            assert {(i, t) for i, t in kept} == {(1, clean(1)), (1, clean(2)), (None, clean(3)), (7, clean(4)), (8, long)}
        assert out.count() == len(kept)

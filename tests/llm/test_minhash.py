import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import minhash as M
from parcelflow.llm.components import components

from .conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n=4):
    sets = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                if a != b:
                    x, y = sorted((a, b), key=lambda k: rows[k][0])
                    top[y] = x
    return [(r[0], len(s), rows[find(i)][0], find(i) == i) for i, (r, s) in enumerate(zip(rows, sets))]


def family(draw, n, words, changes):
    base = [draw.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(draw.randint(0, 99)) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, changes)):
            copy[draw.randrange(words)] = "x" + str(draw.random())
        out.append(" ".join(copy))
    return out


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)] + [(5, 5), (None, 3)]
    top = {n: n for x in links for n in x if n is not None}
    for _ in range(400):
        for a, b in links:
            if a is not None:
                top[a] = top[b] = min(top[a], top[b])
    linked = {n for a, b in links if a != b and a is not None for n in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: top[n] for n in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed):
    draw = random.Random(seed)
    texts = [t for k in range(12) for t in family(draw, draw.randint(1, 9), draw.randint(3, 120), draw.randint(0, 5))]
    texts += family(draw, 60, 200, 8) + ["Alpha BETA gamma", "alpha beta GAMMA", "a b", "a", "a"]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    got = M.near_duplicates(docs_of(rows), M.Settings(words=4)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = M.near_duplicates(docs, M.Settings(words=4)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_odd_rows(docs_of):
    rows = [*enumerate(ODD_TEXTS), (None, "the cat sat"), (None, None), (3, "a"), (12, "the cat sat")]
    docs = docs_of(rows).withColumn("n", F.lit(1)).withColumn("rep", F.lit(2)).withColumn("gone_id", F.lit(3))
    got = M.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[13]["component_id"] == 12 and not by_id[13]["kept"]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[0]["n_shingles"] == 0 and by_id[0]["component_id"] == 0
    kept = M.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_strays_are_compared_with_all(spark, docs_of):
    """A chain: each links with the next only, whatever the centre is."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 16 : k * 16 + 160])) for k in range(12)]
    got = M.near_duplicates(docs_of(rows), M.Settings(words=4)).collect()
    assert {r["component_id"] for r in got} == {b[2] for b in brute(rows)}


def test_rows_that_share_an_id_are_told_apart(docs_of):
    draw = random.Random(5)
    a, b, c = (" ".join(f"{k}{draw.randint(0, 10**6)}" for _ in range(60)) for k in "abc")
    near = c.split()
    near[30] = "changed"
    rows = [(1, a), (7, a), (7, b), (7, b), (3, c), (7, " ".join(near)), (9, b), (2, "of its own"), (2, ""), (5, "x"), (5, "x")]
    docs = docs_of(rows)
    kept = sorted((r["doc_id"], r["text"]) for r in M.without_copies(docs).collect())
    assert kept == sorted([(1, a), (7, b), (7, b), (3, c), (2, "of its own"), (2, ""), (5, "x"), (5, "x")])
    parts = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(docs).collect()}
    assert parts == {
        (1, 56, 1, True), (7, 56, 1, False), (7, 56, 7, True), (3, 56, 3, True), (7, 56, 3, False), (9, 56, 7, False),
        (2, 1, 2, True), (2, 0, 2, True), (5, 1, 5, True),
    }


def test_one_id_on_a_third_of_the_rows(docs_of):
    draw = random.Random(6)
    rows = [(i if i % 3 else 0, " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(20))) for i in range(120)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:60])]
    got = M.near_duplicates(docs_of(rows)).collect()
    assert len(got) == 180 and sum(r["kept"] for r in got) == 120
    assert sorted((r["doc_id"], r["text"]) for r in M.without_copies(docs_of(rows)).collect()) == sorted(rows[:120])

import math
import os
import re
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import contexts as C, pitman_yor as P

from .conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    counts = Counter()
    ends = 0
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
            ends += 1
    n = sum(counts.values()) + ends
    v = len(counts) + (ends > 0)
    out = []
    for i, t in rows:
        c = [counts[w] for w in tokens(t)] + [ends]
        out.append((i, held(i), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return out


def check(rows, docs, use=P.Settings()):
    got = P.score(docs, P.learn(docs, use), use)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    found = sorted(got.collect(), key=key)
    for row, want in zip(found, sorted(brute(rows), key=key), strict=True):
        assert tuple(row)[:5] == want[:5]
        assert row["base_score"] == pytest.approx(want[5], rel=1e-9)
        assert row["score"] < 0
    return got


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scored = check(rows, docs)
    by_fold = {r["held_out"]: r for r in P.perplexity(scored).collect()}
    for r in by_fold.values():
        assert r["perplexity"] < 0.9 * r["base_perplexity"]


def test_odd_rows_and_few_known_words(docs_of):
    rows = [*enumerate(ODD_TEXTS), (None, "some words"), (3, "a b"), (3, "a b")]
    docs = docs_of(rows).withColumn("row", F.lit(1)).withColumn("h", F.lit(2)).withColumn("held", F.lit(3))
    check(rows, docs)
    check(rows, docs, P.Settings(known=3))
    empty = docs.limit(0)
    assert P.score(empty, P.learn(empty)).count() == 0


def test_nothing_to_learn_from(docs_of):
    only = [i for i in range(200) if held(i)][:3]
    rows = [(i, f"words of text {i}") for i in only]
    assert all(r["train_tokens"] == 0 for r in check(rows, docs_of(rows)).collect())


def zipf_texts(texts, words):
    draw = np.random.default_rng(5)
    weights = 1 / np.arange(1, 5001)
    at = draw.choice(5000, (texts, words), p=weights / weights.sum())
    return [" ".join(f"w{x}" for x in row) for row in at]


def test_rounds_write_only_what_can_change(docs_of, monkeypatch):
    """All that learning writes, over eight rounds, is a few times the texts, and a later round a part of the first."""
    written, stage = [], C.stage

    def weighed(df, name):
        out = stage(df, name)
        files = [f.removeprefix("file:") for f in out.inputFiles()]
        written.append((name, sum(os.path.getsize(urlparse(f).path) for f in files)))
        return out

    monkeypatch.setattr(C, "stage", weighed)
    texts = zipf_texts(200, 500)
    P.learn(docs_of(texts), P.Settings(part=1 << 14))
    assert sum(size for _, size in written) < 8 * sum(map(len, texts))
    first, *later = [size for name, size in written if name in ("parts", "moved")]
    assert len(later) == 8 and max(later) < 0.6 * first


def test_probabilities_of_learned_parts_add_up(docs_of):
    """With split restaurants, words of no rank, and contexts that no round moves."""
    texts = [*["a b c a b", "b c a", "c c c b a b a", "a a b", "b"] * 6, *zipf_texts(4, 30), "x y z", "once a b"]
    use = P.Settings(part=40, split=20, merge=30, known=3)
    docs = docs_of([(None, t) for t in texts])
    model = P.learn(docs, use)
    dealer, ranks = model.shared.value
    got = {}
    for x in model.parts.collect():
        got.setdefault(x["dest"], {}).setdefault(x["kind"], []).append((x["src"], bytes(x["data"])))
    parts = {p: C.rested(sorted_mail(x), dealer, ranks, max(1, dealer.parts // 4), use) for p, x in got.items()}
    words = {r["h"]: r["score"] for r in model.words.collect()}
    split = {r["h"]: r["score"] for r in model.split.collect()}
    names = sorted({w for t in texts for w in tokens(t)})
    hashes = dict(zip(names, P._hashes(P.pa.array(names))))
    every = np.append(P._hashes(P.pa.array(names)), [C.END, np.uint64(1)])  # the last was never seen
    unseen = math.log10(1 - sum(10**x for x in words.values()) - 10 ** model.head.scores[1])
    known = ranks.hashes, 10 ** model.head.scores[ranks.ranks]
    for two, one in (("a", "b"), ("c", "c"), ("x", "y"), ("once", "a"), ("b", "x"), ("z", "once")):
        ones = np.full(len(every), hashes[one])
        context = C.context_of(np.full(len(every), hashes[two]), ones)
        part, total = dealer.part(ones, every), 0.0
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            blob = C.plain([x[mine] for x in (ones, context, every)] + [mine])
            logs = np.zeros(len(every))
            for _, kind, _, _, data in C.scores({C.GRAMS: [(0, blob)]}, dealer, known, s=parts.get(p)):
                if kind == C.SUMS:
                    rows, value = C.pickle.loads(data)
                    np.add.at(logs, rows.astype(int), value)
                else:
                    for row, key, of_split in zip(*C.pickle.loads(data)):
                        key = int(key.astype(np.int64))
                        logs[int(row)] += split.get(key, 0.0) if of_split else words.get(key, unseen)
            total += (10 ** logs[mine]).sum()
        assert total == pytest.approx(1, rel=1e-3)


def sorted_mail(got):
    return {kind: sorted(letters) for kind, letters in got.items()}

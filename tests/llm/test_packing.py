"""Packing: ids of the library, whole and gapless sequences, combinations against all subsets, skewed lengths."""

import itertools
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from parcelflow.llm import packing
from parcelflow.llm.settings import TOKENIZERS

from .conftest import ODD_TEXTS

PATH = TOKENIZERS["word_bpe_49k"]
HARD = [
    "I'm we'll DON'T 'S x's ' s", "é ́x a ́", "a<|endoftext|>b <|endo ftext|> <|startoftext|>",
    "　wide spaces\x85next\x1cfile", "ΣΑΣ ΟΔΟΣ, ǅ İ", "12345 1a2b 3.14", "한국어 漢字​zero nb",
    "\x00 \x07 ﻿", "à̖b ̖̀",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    texts = [*HARD, *[t or "" for t in ODD_TEXTS]]
    ours = packing.WordIds(PATH)
    for _ in range(2):
        for text, ids in zip(texts, ours.of_texts(pa.array(texts))):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert list(ours.of_texts(pa.array([], pa.string()))) == []


def brute_fullest(left, room):
    items = [n for n, c in left.items() for _ in range(c)]
    return max(
        (sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0
    )


@pytest.mark.parametrize("seed", range(40))
def test_fullest_combination(seed):
    r = random.Random(seed)
    left = Counter(r.randint(1, 30) for _ in range(r.randint(1, 11)))
    room = r.randint(1, 60)
    chosen = packing.fullest(dict(left), room)
    assert all(c <= left[n] for n, c in chosen.items())
    assert sum(n * c for n, c in chosen.items()) == brute_fullest(left, room)


@pytest.mark.parametrize("seed", range(10))
def test_plans_hold_everything_once(seed):
    r = random.Random(seed)
    counts = dict(Counter(r.choice([3, 7, 64, r.randint(1, 64)]) for _ in range(3000)))
    for steps in (packing.plan(counts, 64), packing.plan(counts, 64, True)):
        held = Counter()
        for s in steps:
            assert 0 < sum(n * c for n, c in s.counts.items()) <= 64
            held.update({n: c * s.times for n, c in s.counts.items()})
        assert held == counts
        least = -(-sum(n * c for n, c in counts.items()) // 64)
        assert least <= sum(s.times for s in steps) <= least * 1.02 + 1


def test_the_number_of_steps_does_not_follow_the_counts():
    few = packing.best_plan({n: 5 for n in range(1, 300)}, 512)
    many = packing.best_plan({n: 5_000_000 for n in range(1, 300)}, 512)
    assert len(many) <= 300 * 10 and sum(s.times for s in many) <= 1_000_000 * sum(s.times for s in few)


def checked(rows, texts, library, capacity=2048):
    """Every piece is there and right, every sequence gapless and within the capacity; returns the sequences."""
    wanted = Counter()
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            wanted[doc_id, piece, start, len(part), crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return bins


def test_odd_texts_repeats_and_clashing_columns(spark, docs_of, library):
    texts = [*enumerate(ODD_TEXTS), (3, "again"), (3, "again"), (None, "no id"), *((i, "copy") for i in range(90, 400))]
    docs = docs_of(texts).withColumns({c: F.lit(1) for c in ("piece", "length", "offset", "_place", "s", "at")})
    bins = checked(packing.pack(docs, PATH).collect(), texts, library)
    lengths = [n for parts in bins.values() for _, n in parts]
    assert len(bins) <= -(-sum(lengths) // 2048) + 1
    assert packing.pack(docs.filter("false"), PATH).count() == 0


@pytest.mark.parametrize("capacity", [1, 5, 16])
def test_small_capacities_need_few_more_sequences_than_the_least(spark, docs_of, library, capacity):
    r = random.Random(capacity)
    texts = [(i, "a " * r.choice([0, 1, 2, 3, 9, 12, 40])) for i in range(400)]
    bins = checked(packing.pack(docs_of(texts), PATH, capacity=capacity).collect(), texts, library, capacity)
    total = sum(n for parts in bins.values() for _, n in parts)
    assert len(bins) <= -(-total // capacity) * 1.1 + 1


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = entry.queries()["op11_best_fit_packing"](spark, sf).collect()
    bins = checked(rows, texts, library)
    # Pieces of more than half a sequence need one each; so do the tokens.
    least = max(-(-sum(r.length for r in rows) // 2048), sum(r.length > 1024 for r in rows))
    assert least <= len(bins) <= least + 1

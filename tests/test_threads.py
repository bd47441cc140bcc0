"""Threads by pointer doubling against a plain walk: chains, branches, circles, odd ids."""

import random

import pytest

from parcelflow.operators import threads as T
from parcelflow.schemas import TWEETS


def plain(rows):
    clean = lambda i: None if i in (None, "", "nan") else i.strip().removesuffix(".0")
    size = lambda i: (len(i), i)
    known = {clean(r[0]) for r in rows} - {None}
    up = {}
    for own, _, _, named in rows:
        for reply in (named or "").split(","):
            reply, own_id = clean(reply), clean(own)
            if reply in known and own_id and reply != own_id:
                up[reply] = min(up.get(reply, own_id), own_id, key=size)
    for start in sorted(known, key=size):  # open circles before their smallest id
        seen, at = [], start
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            del up[min(seen[seen.index(at):], key=size)]
    out = set()
    for own in known:
        at, steps = own, 0
        while at in up:
            at, steps = up[at], steps + 1
        out.add((own, at, steps))
    return out


def found(spark, rows):
    return {tuple(r) for r in T.threads(spark.createDataFrame(rows, TWEETS)).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_random_pointers(spark, seed):
    draw = random.Random(seed)
    ids = draw.sample(range(1, 500), 120)
    rows = []
    for i in ids:
        named = ",".join(str(draw.choice([*ids, 9999])) + draw.choice(["", ".0", " "]) for _ in range(draw.choice([0, 1, 1, 2])))
        rows.append((f"{i}{draw.choice(['', '.0'])}", "True", f"t{i}", named or None))
    rows += [rows[0], (None, "True", "no id", str(ids[0])), ("nan", "False", "x", str(ids[1])), ("", "False", "x", None)]
    assert found(spark, rows) == plain(rows)


def test_a_long_chain_and_a_long_circle(spark):
    rows = [(str(i), "True", "t", str(i + 1)) for i in range(100, 235)]
    rows += [(str(i), "True", "t", str(1000 + (i - 999) % 77)) for i in range(1000, 1077)]
    rows += [("1030", "True", "t", "5"), ("5", "True", "t", "6,7"), ("6", "True", "t", None), ("7", "True", "t", None)]
    got = found(spark, rows)
    assert got == plain(rows) and ("235", "100", 135) not in got and ("234", "100", 134) in got
    assert ("1076", "1000", 76) in got


def test_no_tweets(spark):
    assert found(spark, []) == set()


def test_text_of_threads(spark):
    rows = [("10", "False", "b", "9"), ("2", "True", "a", "10"), ("9", "True", None, None), ("30", "True", "alone", "31")]
    tweets = spark.createDataFrame(rows, TWEETS)
    texts = {r["thread"]: (r["tweets"], r["text"].split("\n<|user|>", 1)[1]) for r in T.thread_texts(tweets, T.threads(tweets)).collect()}
    assert texts == {"2": (3, "\na\n<|assistant|>\nb\n<|user|>\n\n"), "30": (1, "\nalone\n")}

"""Prefix trie against a plain one: long conversations, copies, odd rows, forced spans."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parcelflow.llm import prefix_trie

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = [t[1:] for t in own.get(base, [])[:h] + turns[h:]]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        value = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + value
    out = []
    for p, m in members.items():
        ids = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, COLUMNS)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, entry.queries()["op13_prefix_trie"](spark, str(tmp_path)).collect()), key=repr)


def conversations(seed, n=150, longest=30):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-20, 4 * n), n):
        for turn in range(r.choice([1, 2, 3, 5, 8, 9, 16, 17, longest])):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None])))
    r.shuffle(rows)
    return rows


def test_against_a_plain_trie(spark, tmp_path):
    rows = conversations(1)
    assert found(spark, tmp_path, rows) == plain(rebuilt(rows))


def test_copies_long_ones_and_turnless(spark, tmp_path):
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 300, 5) for t in range(9)]
    rows += [(c, t, "user", "same") for c in range(1, 300, 5) for t in range(2)]
    rows += [(1000, t, "user", f"long {t % 7}") for t in range(700)]
    assert found(spark, tmp_path, rows) == plain(rebuilt(rows))


def test_forced_spans_runs_and_hot_parents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 20)
    rows = conversations(2, 120, 75) + [(c, 0, "user", "copy") for c in range(5000, 5400, 7)]
    assert found(spark, tmp_path, rows) == plain(rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "b", "x"),
        (1, 0, "a", "y"), (2, 0, "user", "x" * 100_000), (2, 1, "usera", "b"), (3, 1, "user", "ab"), (-1, 0, "user", "n"),
    ]
    extra = ["place", "size", "turn_id", "block", "p1", "t1", "depth", "base", "n_bytes", "span"]
    assert found(spark, tmp_path, rows, extra) == plain(rebuilt(rows))


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "a")], [(None, 0, "user", "a")]])
def test_small_tables(spark, tmp_path, rows):
    assert found(spark, tmp_path, rows) == plain(rebuilt(rows))


def test_role_and_text_are_kept_apart(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc")]
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, COLUMNS))
    assert turns.select("turn_id").distinct().count() == 3

import math
import os
from urllib.parse import urlparse

import numpy as np
import pytest

from parcelflow.llm import contexts as C, pitman_yor as P

from .conftest import ODD_TEXTS


def test_contexts_of_rare_words_are_learned(docs_of):
    """Each rare word decides the next one; both are far from the most frequent words."""
    draw = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        at = draw.integers(0, 3000, 20)
        rows.append((i, " ".join(f"a{x} b{x}" for x in at)))
    use = P.Settings(known=500)
    docs = docs_of(rows)
    by_fold = {r["held_out"]: r for r in P.perplexity(P.score(docs, P.learn(docs, use), use)).collect()}
    assert by_fold[True]["perplexity"] < 0.1 * by_fold[True]["base_perplexity"]


def chain(texts, dealer, use, base):
    """The rounds of ``contexts.learned`` without Spark: parts, root's weight, averages by key."""
    def grouped(letters):
        out = {}
        for dest, kind, src, _, data in sorted(letters, key=lambda x: (x[0], x[1], x[2])):
            out.setdefault(dest, {}).setdefault(kind, []).append((src, data))
        return out

    words = {w: np.uint64(i * 7919 + 11) for i, w in enumerate("abc")}
    grams = []
    for t in texts:
        h = np.array([words[w] for w in t.split()], np.uint64)
        one, ctx, own, _ = C.in_turn(h, np.zeros(len(h), np.int64), 1)
        grams.append(np.stack([one, ctx, own, np.ones(len(own), np.uint64)]))
    columns = list(np.concatenate(grams, axis=1))
    sent = C.dealt(dealer.part(columns[0], columns[2]), columns, 0).to_pylist()
    buckets, mail = max(1, dealer.parts // 4), []
    for x in sent:
        s = C.SimpleNamespace(**C.built([x["data"]], dealer))
        mail += [*C.notes(s, x["dest"], buckets), C.state(s, x["dest"])]
    kept, tables, weight = [], 4, 0.0
    for k in range(use.burn + use.kept + 1):
        keeps = k > use.burn
        root = C.SimpleNamespace(base=base, tables=float(tables), all=sum(x[3] for x in mail))
        root.g = np.random.default_rng([1, k]).standard_gamma(use.strength / use.discount + tables)
        told = grouped([x for x in mail if x[1] == C.NOTES] + [x for x in kept if x[1] == C.STATE])
        kept = [y for b, got in told.items() for y in C.added_up(b, got, k, root, use, keeps)]
        root.tables = tables = sum(x[3] for x in kept)
        weight += keeps * (use.strength + use.discount * tables) / (use.strength + root.all) / use.kept
        asked = grouped([x for x in mail if x[1] == C.STATE] + [x for x in kept if x[1] == C.ANSWERS])
        mail = [y for p, got in asked.items() for y in C.seated(p, got, k, root, use, keeps, buckets)]
    by_key = {}
    for x in kept:
        if x[1] == C.STATE:
            h, word, value = C.pickle.loads(x[4])
            by_key.update({(int(a), bool(b)): float(v) for a, b, v in zip(h, word, value)})
    return {x[0]: x for x in mail}, by_key, weight, words


def test_probabilities_add_up_and_parts_do_not_matter():
    """In one part, and in many with restaurants split between them."""
    texts, base = ["a b c a b", "b c a", "c c c b a b a", "a a b", "b"] * 30, 1 / 5
    found = []
    for parts, hot in ((1, []), (9, "abc")):
        use = P.Settings(burn=20, kept=400)
        names = np.sort(np.array([i * 7919 + 11 for i in range(len(hot))], np.uint64))
        dealer = C.Dealer(parts, names, np.full(len(names), 3))
        states, by_key, weight, words = chain(texts, dealer, use, base)
        every = np.array([*words.values(), C.END, 1], np.uint64)  # the last was never seen
        for two, one in (("a", "b"), ("c", "a"), ("b", "b"), ("c", "c")):
            ones = np.full(5, words[one])
            ctx = C.pair_of(np.full(5, words[two]), ones + np.uint64(1))
            total = 0.0
            for part in range(parts):
                mine = np.flatnonzero(dealer.part(ones, every) == part)
                if not len(mine):
                    continue
                blob = np.stack([ones[mine], ctx[mine], every[mine], mine.astype(np.uint64)]).tobytes()
                got = {C.GRAMS: [(0, blob)]} | ({C.STATE: [(part, states[part][4])]} if part in states else {})
                logs = np.zeros(5)
                for _, kind, _, _, data in C.scores(got, dealer, (np.zeros(0, np.uint64), np.zeros(0))):
                    if kind == C.SUMS:
                        rows, value = C.pickle.loads(data)
                        logs[rows.astype(int)] += value
                    else:
                        for row, key, split in zip(*C.pickle.loads(data)):
                            rest = by_key.get((int(key), not split), 1.0 if split else 0.0)
                            logs[int(row)] += math.log10(rest if split else rest + weight * base)
                total += (10 ** logs[mine]).sum()
                found.append((parts, two + one, mine, logs[mine]))
            assert total == pytest.approx(1, rel=1e-3)
    whole = {k: x for n, k, _, x in found if n == 1}
    for n, k, mine, x in found:
        if n > 1:
            assert x == pytest.approx(whole[k][mine], abs=0.1)


def test_odd_rows_in_many_parts(docs_of):
    docs = docs_of([*enumerate(ODD_TEXTS), (None, "some words"), (3, "a b"), (3, "a b")])
    use = P.Settings(part=20, split=5, merge=10, known=2)
    assert P.score(docs, P.learn(docs, use), use).filter("score >= 0 or score is null").count() == 0


def test_turns():
    h = np.array([7, 8, 9], np.uint64)
    one, context, own, text = C.in_turn(h, np.array([0, 0, 2]), 3)
    assert own.tolist() == [7, 8, C.END, C.END, 9, C.END] and text.tolist() == [0, 0, 0, 1, 2, 2]
    assert one.tolist() == [C.END, 7, 8, C.END, C.END, 9]
    assert context[0] == context[3] == context[4] != context[1]


def test_scoring_gets_only_what_it_reads(docs_of, monkeypatch):
    """What rounds alone need, and the n-grams as they were dealt, are gone before texts are scored."""
    staged, stage = {}, C.stage

    def kept(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(C, "stage", kept)
    model = P.learn(docs_of(["a b c a b c", "b c a b c"] * 5))
    assert {r["kind"] for r in model.parts.select("kind").distinct().collect()} <= {C.BASE, C.STATE, C.RARE, C.SHARED}
    for name in ("parts", "core", "known", "moved"):
        folder = os.path.dirname(urlparse(staged[name].inputFiles()[0]).path)
        assert not os.path.exists(folder)


def test_places_and_order_of_any_hashes():
    draw = np.random.default_rng(3)
    some = draw.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    for keys in (some, some >> np.uint64(40), some | np.uint64(1 << 63), some[:1], some[:0], np.repeat(some[:9], 300)):
        order, found = C.ordered(keys)
        assert np.array_equal(order, np.argsort(keys, kind="stable")) and np.array_equal(found, keys[order])
        distinct = np.unique(keys)
        wanted = np.concatenate([keys, some, np.array([0, 2**64 - 1], np.uint64)])
        place = {int(k): i for i, k in enumerate(distinct)}
        assert C.Places(distinct).find(wanted).tolist() == [place.get(int(w), -1) for w in wanted]
        assert C.find(distinct, wanted).tolist() == [place.get(int(w), -1) for w in wanted]


def test_words_of_any_length_have_hashes_of_their_own():
    words = ["", "a", "ab", "\0", "\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "x" * 63, "x" * 64, "x" * 65, "x" * 3000, "ß"]
    words += [str(i) for i in range(3000)]
    hashes = P._hashes(P.pa.array(words))
    assert len(np.unique(hashes)) == len(words)
    assert np.array_equal(P._hashes(P.pa.array(["other", *words]).slice(1)), hashes)
    assert len(P._hashes(P.pa.array([], P.pa.string()))) == 0

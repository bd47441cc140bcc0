"""Restaurants of all observed contexts, as parts that Spark tasks seat.

Words are 64-bit hashes.  A trigram (two, one, word) is a customer of the context (two, one); a table opened there is
a customer of the context (one), a table opened there one of the root, whose base is uniform.  N-grams are counted
by partial aggregation and dealt into parts by ``one``, so that a part holds restaurants of ``one`` and all below
them.  A frequent ``one`` is dealt by the word as well; the totals of its restaurants then lie in several parts.

A round of Gibbs sampling has two steps.  Parts send their tables by word, and totals of split restaurants, to
buckets of keys, which add them up, seat the root and answer.  Then every part seats all customers of its dishes
anew (``tables.draw``), the longer contexts first, against their parents' present customers without their own.

What never changes is written once.  A trigram met once has one table in any case, and so has a pair of words met
once; a round moves the others only (``core``), and a part sends of its words by how much their customers are fewer
than their tokens, which the buckets know.  At the end the parts take the rest in again (``whole``).  N-grams travel
and are kept as ranks of the most frequent words, three bytes each before compression (``Ranks``).
"""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelflow.staging import stage

from .tables import draw

MAIL = "dest bigint, kind int, src bigint, total double, data binary"
GRAMS, STATE, NOTES, ANSWERS, SUMS, REST, CORE, BASE, RARE, SHARED, TOTAL, TEXTS = range(12)
WORD, SPLIT = 0, 1  # kinds of keys in notes
END = np.uint64(0x9E6D62D06F6A9A9B)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ mix(b))


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of 64-bit keys, equal ones in turn, and the keys in that order.

    Numbers are sorted several times faster than places of them, so places take the last bits of the keys.
    """
    keys = keys.astype(np.uint64, copy=False)
    if not len(keys):
        return np.zeros(0, np.int64), keys
    bits = np.uint64(len(keys).bit_length())
    last = (np.uint64(1) << bits) - np.uint64(1)
    fits = int(keys.max()) >> int(64 - bits) == 0
    packed = keys << bits if fits else keys & ~last
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= last
    order = packed.view(np.int64)
    found = keys[order]
    if not fits and (found[1:] < found[:-1]).any():  # keys that differ in their last bits only, which are few in hashes
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, found


class Places:
    """Places in ascending hashes, looked for from the first one that begins with the same bits."""

    STEPS = 16  # from there; hashes take fewer

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys.astype(np.uint64, copy=False), max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        begin = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)
        np.cumsum(begin[:-1], out=begin[1:])
        begin[0] = 0
        self.starts = np.minimum(begin, max(0, len(keys) - 1)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place, or -1."""
        keys, size = self.keys, len(self.keys)
        if not size:
            return np.full(len(wanted), -1)
        at = self.starts[wanted >> self.shift]
        less = np.flatnonzero(keys[at] < wanted)
        for _ in range(self.STEPS):
            at[less] += 1
            less = less[at[less] < size]
            less = less[keys[at[less]] < wanted[less]]
            if not len(less):
                break
        at[less] = np.searchsorted(keys, wanted[less])
        at = np.minimum(at, size - 1)
        return np.where(keys[at] == wanted, at, -1)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place in ascending keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    if len(wanted) > len(keys) // 4 > 256:
        return Places(keys).find(wanted)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def at_or(values: np.ndarray, place: np.ndarray, other: float) -> np.ndarray:
    return np.where(place >= 0, values[place], other) if len(values) else np.full(len(place), other)


def turns(words: np.ndarray, text: np.ndarray, n: int, end):
    """``two``, ``one``, word and text of all tokens, ends included; a text begins after two ends."""
    per_text = np.bincount(text, minlength=n)
    own = np.full(len(words) + n, end, words.dtype)
    ends = np.cumsum(per_text + 1) - 1
    word = np.ones(len(own), bool)
    word[ends] = False
    own[word] = words
    one, two = np.full(len(own), end, own.dtype), np.full(len(own), end, own.dtype)
    one[1:] = own[:-1]
    two[1:] = one[:-1]
    two[ends - per_text] = end  # nothing before the text counts
    return two, one, own, np.repeat(np.arange(n), per_text + 1)


def context_of(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    return pair_of(two, one + np.uint64(1))


def in_turn(words: np.ndarray, text: np.ndarray, n: int):
    """``one``, context, word and text of all tokens, by hash."""
    two, one, own, of = turns(words, text, n, END)
    return one, context_of(two, one), own, of


class Dealer:
    """Which part an n-gram belongs to; ``hot`` are ascending hashes, ``salts`` how many parts each is cut into."""

    def __init__(self, parts: int, hot: np.ndarray, salts: np.ndarray):
        self.parts, self.hot, self.salts = parts, hot, salts

    def part(self, one: np.ndarray, word: np.ndarray) -> np.ndarray:
        salts = at_or(self.salts, find(self.hot, one), 1).astype(np.uint64)
        return (mix(one + mix(word) % salts) % np.uint64(self.parts)).astype(np.int64)

    def split(self, one: np.ndarray) -> np.ndarray:
        return find(self.hot, one) >= 0


def plain(columns: list[np.ndarray]) -> bytes:
    return np.stack([c.astype(np.uint64) for c in columns]).tobytes()


def dealt(part: np.ndarray, columns: list[np.ndarray], src: int, pack=plain) -> pa.RecordBatch:
    """N-grams as one row of mail for each part."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    columns = [c[order] for c in columns]
    part = part[order]
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(order))
    data = [pack([c[a:b] for c in columns]) for a, b in zip(start, ends)]
    return mail([(int(d), GRAMS, src, 0.0, x) for d, x in zip(part[start], data)])


def small(data: bytes) -> bytes:
    """Compressed, its size before."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def large(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def sealed(x) -> bytes:
    return small(pickle.dumps(x, 5))


def unsealed(data: bytes):
    return pickle.loads(large(data))


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, the first bytes of all, then the second ones and so on."""
    x = np.asarray(x, np.uint32)
    return b"".join((x >> np.uint32(8 * i)).astype(np.uint8).tobytes() for i in range(4))


def numbers(packed: bytes) -> np.ndarray:
    """What ``planes`` has packed."""
    first, *more = np.frombuffer(packed, np.uint8).reshape(4, -1)
    out = first.astype(np.uint32)
    for i, plane in enumerate(more, 1):
        out |= plane.astype(np.uint32) << np.uint32(8 * i)
    return out


class Ranks:
    """N-grams as ranks of words; 0 is a word that has none, whose hash follows.  ``hashes`` are ordered by rank."""

    def __init__(self, hashes: np.ndarray):
        self.by_rank = np.concatenate([np.zeros(1, np.uint64), hashes])
        order, self.hashes = ordered(hashes)
        self.ranks, self.places = order + 1, Places(self.hashes)

    def __reduce__(self):
        return Ranks, (self.by_rank[1:],)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return at_or(self.ranks, self.places.find(hashes), 0).astype(np.uint32)

    def pack(self, ranks: np.ndarray, rest: np.ndarray, number: np.ndarray) -> bytes:
        """``ranks`` of all ``two``, ``one`` and words in turn; ``rest``: hashes of those that are 0."""
        return sealed((len(number), planes(np.append(ranks, number)), rest.tobytes()))

    def packer(self, hashes: np.ndarray, ranks: np.ndarray | None = None):
        """Packs columns of places in ``hashes``, and a number; ``ranks`` are those of ``hashes``."""
        ranks = self.of(hashes) if ranks is None else ranks

        def pack(columns: list[np.ndarray]) -> bytes:
            at = np.concatenate(columns[:3])
            rank = ranks[at]
            return self.pack(rank, hashes[at[rank == 0]], columns[3])

        return pack

    def grams(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks and hashes of ``two``, ``one`` and words, a row each, and the number."""
        n, packed, rest = unsealed(data)
        got = numbers(packed).reshape(4, n)
        words = self.by_rank[got[:3]]
        words[got[:3] == 0] = np.frombuffer(rest, np.uint64)
        return got[:3], words, got[3]

    def read(self, data: bytes) -> tuple[np.ndarray, ...]:
        """``one``, context, word by hash, and the number."""
        _, (two, one, word), number = self.grams(data)
        return one, context_of(two, one), word, number


def mail(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in MAIL.split(", ")])


def unpacked(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.uint64).reshape(4, -1) for b in blobs], axis=1)


def runs(values: np.ndarray) -> np.ndarray:
    """Where equal values, which stand together, begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, a place of each, and which one every value is."""
    order, found = ordered(x)
    first = runs(found)
    which = np.empty(len(x), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    return found[first], order[first], which


def counted(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of every distinct key, ascending by key, and its total."""
    order, found = ordered(key)
    first = runs(found)
    return order[first], np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def merged(one, context, word, n):
    """Equal n-grams as one, ordered by key."""
    key = pair_of(context, word)
    at, total = counted(key, n)
    return one[at], context[at], word[at], total, key[at]


# --- parts -----------------------------------------------------------------------------------------


def built(blobs: list[bytes], dealer: Dealer) -> dict:
    """A part with one table for every dish."""
    return restaurants(*merged(*unpacked(blobs)), dealer)


def restaurants(one, context, word, n, key, dealer: Dealer) -> dict:
    """Of n-grams that ``merged`` has ordered."""
    pair_key, first, row_pair = numbered(pair_of(one, word + np.uint64(2)))
    ctx, ctx_first, row_ctx = numbered(context)
    ones, _, pair_one = numbered(one[first])
    words, _, pair_word = numbered(word[first])
    split = dealer.split(ones)
    split_ctx = np.flatnonzero(split[find(ones, one[ctx_first])])
    short = lambda x: x.astype(np.int32)
    zeros = lambda x: np.zeros(len(x), np.float32)
    none = lambda x: np.zeros(len(x), np.int32)
    return dict(
        key=key, row_ctx=short(row_ctx), row_pair=short(row_pair), n=short(n), t3=np.ones(len(n), np.int32),
        pair_key=pair_key, pair_one=short(pair_one), pair_word=short(pair_word), t2=np.ones(len(pair_key), np.int32),
        ctx=ctx, ones=ones, words=words, split_ones=np.flatnonzero(split), split_ctx=split_ctx,
        split_keys=np.concatenate([ones[split], ctx[split_ctx]]),
        more_c2=none(pair_key), more3=none(ctx), told3=none(ctx), more2=none(ones), less1=none(words),
        own3=zeros(key), weight3=zeros(ctx), own2=zeros(pair_key), weight2=zeros(ones), share2=zeros(ones),
        p1=np.zeros(len(words)),
    )


def living(s: SimpleNamespace) -> SimpleNamespace:
    """Which n-grams, pairs, contexts, words before and words have a number of tables that can change."""
    rows = s.n > 1
    pairs = np.bincount(s.row_pair, s.n, len(s.pair_key)) > 1
    ctx, ones, words = (np.zeros(len(x), bool) for x in (s.ctx, s.ones, s.words))
    ctx[s.row_ctx[rows]] = ones[s.pair_one[pairs]] = words[s.pair_word[pairs]] = ones[s.split_ones] = True
    return SimpleNamespace(rows=rows, pairs=pairs, ctx=ctx, ones=ones, words=words)


def core(s: SimpleNamespace) -> SimpleNamespace:
    """What rounds move of a new part: all that can change, and counts of the rest."""
    on = living(s)
    new = {k: np.cumsum(getattr(on, k)).astype(np.int32) - 1 for k in ("pairs", "ctx", "ones", "words")}
    count = lambda at, keep, w=None: np.bincount(at, w, len(keep))[keep].astype(np.int32)
    tokens = np.bincount(s.row_pair, s.n, len(s.pair_key))
    all3 = np.bincount(s.row_ctx, s.n, len(s.ctx))[on.ctx].astype(np.int32)
    split_ctx = s.split_ctx[on.ctx[s.split_ctx]]
    zeros = lambda keep: np.zeros(keep.sum(), np.float32)
    return SimpleNamespace(
        row_ctx=new["ctx"][s.row_ctx[on.rows]], row_pair=new["pairs"][s.row_pair[on.rows]], n=s.n[on.rows],
        t3=s.t3[on.rows], t2=s.t2[on.pairs], pair_one=new["ones"][s.pair_one[on.pairs]],
        pair_word=new["words"][s.pair_word[on.pairs]], words=s.words[on.words],
        split_ones=new["ones"][s.split_ones], split_ctx=new["ctx"][split_ctx],
        split_keys=np.concatenate([s.ones[s.split_ones], s.ctx[split_ctx]]),
        more_c2=count(s.row_pair[~on.rows], on.pairs), more3=count(s.row_ctx[~on.rows], on.ctx), told3=all3,
        more2=count(s.pair_one[~on.pairs], on.ones), less1=count(s.pair_word[on.pairs], on.words, tokens[on.pairs]),
        own3=zeros(on.rows), weight3=zeros(on.ctx), own2=zeros(on.pairs), weight2=zeros(on.ones),
        share2=zeros(on.ones), p1=np.zeros(on.words.sum()),
    )


def whole(s: SimpleNamespace, c: SimpleNamespace, shared: np.ndarray, rare: np.ndarray, use) -> None:
    """Averages of all of a new part: those that rounds moved, those that follow from counts, and what buckets answered."""
    d, a = use.discount, use.strength
    on = living(s)
    all3, tables3 = np.bincount(s.row_ctx, s.n, len(s.ctx)).astype(float), np.bincount(s.row_ctx, minlength=len(s.ctx))
    all2 = np.bincount(s.pair_one, minlength=len(s.ones))
    s.weight3[:], s.weight2[:], s.share2[:] = (a + d * tables3) / (a + all3), (a + d * all2) / (a + all2), 1 / (a + all2)
    s.weight3[on.ctx], s.weight2[on.ones], s.share2[on.ones] = c.weight3, c.weight2, c.share2
    if len(s.split_ctx):
        all3[s.split_ctx], s.weight3[s.split_ctx] = shared
    s.own3[:], s.own2[:] = (1 - d) / (a + all3[s.row_ctx]), (1 - d) * s.share2[s.pair_one]
    s.own3[on.rows], s.own2[on.pairs] = c.own3, c.own2
    s.p1[:] = np.nan
    s.p1[on.words] = c.p1
    if len(rare):
        s.p1[find(s.words, rare[0].view(np.uint64))] = rare[1]


def totals(s: SimpleNamespace) -> None:
    """Customers and tables of restaurants, as far as they lie in this part."""
    s.c2 = (np.bincount(s.row_pair, s.t3, len(s.t2)) + s.more_c2).astype(np.int64)
    s.tables3 = np.bincount(s.row_ctx, s.t3, len(s.more3)) + s.more3
    s.all3 = np.bincount(s.row_ctx, s.n, len(s.more3)) + s.more3
    s.all2 = np.bincount(s.pair_one, s.c2, len(s.more2)) + s.more2
    s.tables2 = np.bincount(s.pair_one, s.t2, len(s.more2)) + s.more2


def note_keys(s: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([s.words, s.split_keys])
    kind = np.full(len(key), SPLIT, np.uint8)
    kind[: len(s.words)] = WORD
    return key, kind


def by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each bucket, in order."""
    bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, runs(bucket[order])[1:]) if len(order) else ():
        yield int(bucket[at[0]]), at


def notes(s: SimpleNamespace, part: int, buckets: int) -> list[tuple]:
    """What buckets have to know of this part."""
    totals(s)
    key, kind = note_keys(s)
    by_word = np.bincount(s.pair_word, s.t2, len(s.words)) - s.less1
    more3, told3 = s.more3[s.split_ctx], s.told3[s.split_ctx]
    x = np.concatenate([by_word, s.all2[s.split_ones], s.all3[s.split_ctx] - told3]).astype(np.int32)
    y = np.concatenate([np.zeros(len(s.words)), s.tables2[s.split_ones], s.tables3[s.split_ctx] - more3]).astype(np.int32)
    out = []
    for b, at in by_bucket(key, buckets):
        data = sealed((key[at], kind[at], x[at], y[at]))
        out.append((b, NOTES, part, float(x[at][kind[at] == WORD].sum()), data))
    return out


def lasting(s: SimpleNamespace, part: int, buckets: int, ranks: Ranks) -> list[tuple]:
    """What buckets have to know once: contexts of split restaurants, and the words that scoring has to ask for."""
    on, key = living(s), s.ctx[s.split_ctx]
    customers = np.bincount(s.row_ctx, s.n, len(s.ctx))[s.split_ctx].astype(np.int32)
    tables = np.bincount(s.row_ctx[~on.rows], minlength=len(s.ctx))[s.split_ctx].astype(np.int32)
    live, out = on.ctx[s.split_ctx], []
    for b, at in by_bucket(key, buckets):
        out.append((b, SHARED, part, 0.0, sealed((key[at], customers[at], tables[at], live[at]))))
    rare = s.words[~on.words]
    rare = rare[ranks.of(rare) == 0]
    return out + [(b, RARE, part, 0.0, sealed(rare[at])) for b, at in by_bucket(rare, buckets)]


def heard(s: SimpleNamespace, answers: list[tuple[int, bytes]], buckets: int) -> None:
    """Take in the answers: customers and tables of the root by word, totals and g of split restaurants."""
    key, _ = note_keys(s)
    got, answers = np.zeros((3, len(key))), dict(answers)
    for b, at in by_bucket(key, buckets):
        for row, x in zip(got, unsealed(answers[b])):
            row[at] = x
    s.c1, s.t1 = got[:2, : len(s.words)]
    n = len(s.words) + len(s.split_ones)
    s.split2, s.split3 = got[:, len(s.words) : n], got[:, n:]
    s.all2[s.split_ones], s.tables2[s.split_ones] = s.split2[:2]
    s.all3[s.split_ctx], s.tables3[s.split_ctx] = s.split3[:2]


def keep(s: SimpleNamespace, root, use) -> None:
    """Add the present shares to the averages."""
    d, a = use.discount, use.strength
    s.own3 += ((s.n - d * s.t3) / (a + s.all3[s.row_ctx]) / use.kept).astype(np.float32)
    s.weight3 += ((a + d * s.tables3) / (a + s.all3) / use.kept).astype(np.float32)
    s.own2 += ((s.c2 - d * s.t2) / (a + s.all2[s.pair_one]) / use.kept).astype(np.float32)
    s.weight2 += ((a + d * s.tables2) / (a + s.all2) / use.kept).astype(np.float32)
    s.share2 += (1 / (a + s.all2) / use.kept).astype(np.float32)
    s.p1 += (s.c1 - d * s.t1 + (a + d * root.tables) * root.base) / (a + root.all) / use.kept


def sweep(s: SimpleNamespace, root, use, rng) -> None:
    """Seat all customers of both levels anew."""
    d, a = use.discount, use.strength
    g3, g2 = (rng.standard_gamma(a / d + t) for t in (s.tables3, s.tables2))
    g2[s.split_ones], g3[s.split_ctx] = s.split2[2], s.split3[2]
    rows = np.flatnonzero(s.n > 1)
    pair = s.row_pair[rows]
    one, word = s.pair_one[pair], s.pair_word[pair]
    others = s.c2[pair] - s.t3[rows]
    tables = np.minimum(s.t2[pair], others)
    gone = s.t2[pair] - tables
    c1 = s.c1[word] - gone
    p1 = (c1 - d * np.minimum(s.t1[word], c1) + (a + d * root.tables) * root.base) / (a + root.all)
    own = others - d * np.maximum(tables, 1) + (a + d * (s.tables2[one] - gone)) * p1
    s.t3[rows] = draw(s.n[rows], np.log(d * g3[s.row_ctx[rows]]), rng, d, own, a + s.all2[one] - s.t3[rows])

    c2 = (np.bincount(s.row_pair, s.t3, len(s.t2)) + s.more_c2).astype(np.int64)
    word = s.pair_word
    others = s.c1[word] - s.t2
    own = others - d * np.maximum(np.minimum(s.t1[word], others), 1) + (a + d * root.tables) * root.base
    s.t2[:] = draw(c2, np.log(d * g2[s.pair_one]), rng, d, own, a + root.all - s.t2)


MOVED = "t3 t2 own3 weight3 own2 weight2 share2 p1".split()
CORE_FIELDS = (
    "row_ctx row_pair n pair_one pair_word words split_ones split_ctx split_keys more_c2 more3 told3 more2 less1"
).split()
FIELDS = [*MOVED, *CORE_FIELDS, *"key pair_key ctx ones".split()]


def state(s: SimpleNamespace, part: int, fields: list[str] = FIELDS, kind: int = STATE) -> tuple:
    return part, kind, part, 0.0, sealed({f: getattr(s, f) for f in fields})


def opened(*data: bytes) -> SimpleNamespace:
    return SimpleNamespace(**{k: v.copy() for x in data for k, v in unsealed(x).items()})


def by_kind(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list] = {}
    for kind, src, data in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "src", "data")))):
        out.setdefault(kind, []).append((src, data))
    return out


def posted(df: DataFrame, act) -> DataFrame:
    """Mail that ``act(dest, mail by kind)`` sends, for every dest."""

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([mail(act(key[0].as_py(), by_kind(table)))])

    return df.groupBy("dest").applyInArrow(one, MAIL)


# --- rounds ----------------------------------------------------------------------------------------


def added_up(bucket: int, got: dict, round_: int, root, use, keeps: bool) -> list[tuple]:
    """A bucket of keys: sums of its notes and of what it knows, seats of the root, averages, answers."""
    d, a = use.discount, use.strength
    known = [(None, *unsealed(data)) for _, data in got.get(BASE, ())]
    letters = known + [(src, *unsealed(data)) for src, data in got.get(NOTES, ())]
    key, kind, x, y = (np.concatenate(c) for c in list(zip(*letters))[1:])
    keys, first, place = numbered(key ^ kind)
    x, y = np.bincount(place, x), np.bincount(place, y)
    is_word = kind[first] == WORD
    rng = np.random.default_rng([7, round_, bucket])
    words = np.flatnonzero(is_word)
    y[words] = draw(x[words].astype(np.int64), np.full(len(words), np.log(d * root.g * root.base)), rng, d)
    z = rng.standard_gamma(a / d + y)
    out = [(bucket, TOTAL, bucket, float(y[words].sum()), b"")]
    if keeps or STATE in got:
        _, _, average = pickle.loads(got[STATE][0][1]) if STATE in got else (0, 0, np.zeros(len(keys)))
        share = np.where(is_word, (x - d * y) / (a + root.all), (a + d * y) / (a + x))
        data = pickle.dumps((key[first], is_word, average + share * (keeps / use.kept)), 5)
        out.append((bucket, STATE, bucket, 0.0, data))
    at = 0
    for src, own, *_ in letters:
        mine = place[at : at + len(own)]
        at += len(own)
        if src is not None:
            told = x[mine].astype(np.int64), y[mine].astype(np.int64), np.where(is_word[mine], 0, z[mine])
            out.append((src, ANSWERS, bucket, 0.0, sealed(told)))
    return out


def seated(part: int, got: dict, round_: int, root, use, keeps: bool, buckets: int) -> list[tuple]:
    parts = [got[kind][0][1] for kind in (CORE, STATE) if kind in got]
    s = opened(*parts)
    fields = FIELDS if len(parts) == 1 else MOVED
    totals(s)
    heard(s, got.get(ANSWERS, ()), buckets)
    if keeps:
        keep(s, root, use)
    if round_ == use.burn + use.kept:
        return [state(s, part, fields)]
    sweep(s, root, use, np.random.default_rng([8, round_, part]))
    return [*notes(s, part, buckets), state(s, part, fields)]


def shared_of(got: dict) -> tuple[np.ndarray, ...]:
    """Of split contexts, by key: customers, tables that do not change, and whether others do."""
    key, x, y, live = (np.concatenate(c) for c in zip(*(unsealed(data) for _, data in got.get(SHARED, ()))))
    keys, place = np.unique(key, return_inverse=True)
    return keys, np.bincount(place, x), np.bincount(place, y), np.bincount(place, live) > 0


def knowing(bucket: int, got: dict) -> list[tuple]:
    """What a bucket knows from the beginning: its words' tokens, what is fixed in split contexts."""
    key, x = (np.concatenate(c) for c in zip(*([unsealed(data) for _, data in got.get(RARE, ())] or [[np.zeros(0, np.uint64)] * 2])))
    y = np.zeros(len(key), np.int64)
    kind = np.full(len(key), WORD, np.uint8)
    if SHARED in got:
        keys, customers, tables, live = shared_of(got)
        key, x, y = (np.concatenate(c) for c in ((key, keys[live]), (x, customers[live]), (y, tables[live])))
        kind = np.append(kind, np.full(live.sum(), SPLIT, np.uint8))
    if not len(key):
        return []
    return [(bucket, BASE, bucket, 0.0, sealed((key, kind, x.astype(np.int64), y.astype(np.int64))))]


def told_last(bucket: int, got: dict, alone: float, more: float, use) -> list[tuple]:
    """Averages of a bucket: all of them, and to each part those that it has asked for.

    ``alone`` is the share of a word met once, ``more`` what the root's base adds to a word's share.
    """
    d, a = use.discount, use.strength
    key, is_word, value = pickle.loads(got[STATE][0][1]) if STATE in got else (np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0))
    order = np.argsort(key)
    word_at, split_at = order[is_word[order]], order[~is_word[order]]
    out = []
    for src, data in got.get(RARE, ()):
        asked = unsealed(data)
        p = at_or(value[word_at], find(key[word_at], asked), alone) + more
        out.append((src, RARE, bucket, 0.0, sealed(np.stack([asked.view(np.float64), p]))))
    if SHARED in got:
        keys, x, y, live = shared_of(got)
        weight = (a + d * y) / (a + x)
        weight[live] = value[split_at[find(key[split_at], keys[live])]]
        for src, data in got[SHARED]:
            at = find(keys, unsealed(data)[0])
            out.append((src, SHARED, bucket, 0.0, sealed(np.stack([x[at], weight[at]]))))
        key, is_word, value = (np.concatenate(c) for c in ((key, keys[~live]), (is_word, np.zeros((~live).sum(), bool)), (value, weight[~live])))
    out.append((bucket, STATE, bucket, 0.0, pickle.dumps((key, is_word, value), 5)))
    return out


def removed(*tables: DataFrame) -> None:
    """Delete staged tables that are read no more."""
    spark = tables[0].sparkSession
    for file in (f for df in tables for f in df.inputFiles()[:1]):
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffles of jobs that are over once the driver's garbage is collected, Python's first."""
    gc.collect()
    for _ in range(2):  # what the first frees may hold more
        spark._jvm.System.gc()
        time.sleep(0.3)


def of_kind(df: DataFrame, *kinds: int) -> DataFrame:
    return df.filter(F.col("kind").isin(*kinds))


def learned(grams: DataFrame, words: DataFrame, shared, base: float, alone: int, tokens: int, tables: int, use):
    """Parts with averaged shares, averages by key (h, word, value), of a word met once, and the root's of its base.

    ``words`` are those met more than once (h, c), ``alone`` is the number of others, ``tokens`` that of all;
    ``shared`` is the broadcast dealer, with the ranks.
    """
    buckets = max(1, shared.value[0].parts // 4)

    def first(part: int, got: dict) -> list[tuple]:
        dealer, ranks = shared.value
        rank, words, n = (np.concatenate(c, axis=-1) for c in zip(*(ranks.grams(data) for _, data in got[GRAMS])))
        at, total = counted(pair_of(context_of(*words[:2]), words[2]), n)
        rank, words = rank[:, at], words[:, at]
        two, one, word = words
        context = context_of(two, one)
        s = SimpleNamespace(**restaurants(one, context, word, total, pair_of(context, word), dealer))
        bits = np.uint64(len(ranks.by_rank).bit_length())
        order, _ = ordered((s.pair_one[s.row_pair].astype(np.uint64) << bits) + rank[0])  # packs better
        rank, words = rank[:, order], words[:, order]
        kept = ranks.pack(rank.ravel(), words[rank == 0], total[order])
        moved = core(s)
        return [
            (part, GRAMS, part, 0.0, kept), *lasting(s, part, buckets, ranks), *notes(moved, part, buckets),
            state(moved, part, CORE_FIELDS, CORE), state(moved, part, MOVED),
        ]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = batch.column("h").to_numpy().view(np.uint64), batch.column("c").to_numpy()
            yield mail([(b, RARE, -1, 0.0, sealed((h[at], c[at]))) for b, at in by_bucket(h, buckets)])

    parts = stage(posted(grams, first), "parts")
    let_go(parts.sparkSession)  # the n-grams as they were dealt
    moves = stage(of_kind(parts, CORE), "core")  # rounds read no n-grams
    told = of_kind(parts, SHARED).unionByName(words.mapInArrow(sent, MAIL))
    known = stage(posted(told, knowing), "known")
    post, kept, weight, share = parts, parts.limit(0), 0.0, 0.0
    for round_ in range(use.burn + use.kept + 1):
        keeps = round_ > use.burn
        root = SimpleNamespace(base=base, tables=float(tables))
        root.all = float(tokens) + (of_kind(post, NOTES).agg(F.sum("total")).first()[0] or 0.0)
        root.g = np.random.default_rng([6, round_]).standard_gamma(use.strength / use.discount + tables)
        told = of_kind(post, NOTES).unionByName(known).unionByName(of_kind(kept, STATE))
        add = lambda b, got, k=round_, r=root, y=keeps: added_up(b, got, k, r, use, y)
        answers = stage(posted(told, add), "answers")
        root.tables = tables = alone + (of_kind(answers, TOTAL).agg(F.sum("total")).first()[0] or 0.0)
        weight += keeps * (use.strength + use.discount * tables) / (use.strength + root.all) / use.kept
        share += keeps * (1 - use.discount) / (use.strength + root.all) / use.kept
        asked = moves.unionByName(of_kind(post, STATE)).unionByName(of_kind(answers, ANSWERS))
        seat = lambda p, got, k=round_, r=root, y=keeps: seated(p, got, k, r, use, y, buckets)
        then = stage(posted(asked, seat), "moved")
        if round_:
            removed(post, kept)
        post, kept = then, answers

    value = lambda b, got: told_last(b, got, share, weight * base, use)
    last = stage(posted(of_kind(kept, STATE).unionByName(of_kind(parts, SHARED, RARE)), value), "last")
    removed(kept, known, moves)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                h, word, value = pickle.loads(data)
                columns = [pa.array(h.view(np.int64)), pa.array(word), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "word", "value"])

    by_key = of_kind(last, STATE).select("data").mapInArrow(listed, "h bigint, word boolean, value double")
    by_key = stage(by_key, "by-key")
    model = of_kind(parts, GRAMS).withColumn("kind", F.lit(BASE))
    model = stage(model.unionByName(post).unionByName(of_kind(last, RARE, SHARED)), "model")
    removed(parts, post, last)
    return model, by_key, share, weight


def rested(got: dict, dealer: Dealer, ranks: Ranks, buckets: int, use) -> SimpleNamespace | None:
    """A part with all its averages, if there is one."""
    if BASE not in got:
        return None
    s = SimpleNamespace(**restaurants(*merged(*ranks.read(got[BASE][0][1])), dealer))
    shared, told = np.zeros((2, len(s.split_ctx))), dict(got.get(SHARED, ()))
    for b, at in by_bucket(s.ctx[s.split_ctx], buckets):
        shared[:, at] = unsealed(told[b])
    rare = [unsealed(data) for _, data in got.get(RARE, ())]
    whole(s, opened(got[STATE][0][1]), shared, np.concatenate(rare, axis=1) if rare else np.zeros(0), use)
    return s


def plain_read(data: bytes) -> np.ndarray:
    return unpacked([data])


EMPTY = dict(
    key="u8", pair_key="u8", ctx="u8", ones="u8", words="u8", own3="f", weight3="f", own2="f", weight2="f", p1="d",
    row_ctx="i", row_pair="i", pair_one="i", pair_word="i",
)


def scores(got: dict, dealer: Dealer, known: tuple[np.ndarray | Places, np.ndarray], read=plain_read, s=None) -> list[tuple]:
    """A part's answers to texts: sums of log10 probabilities by row, and keys whose logarithm is to be added.

    ``s`` is the part; it is taken from the mail if it is not given.
    """
    if GRAMS not in got:
        return []
    if s is None:
        s = opened(got[STATE][0][1]) if STATE in got else SimpleNamespace(**{k: np.zeros(0, v) for k, v in EMPTY.items()})
    known, p_known = (known[0] if isinstance(known[0], Places) else Places(known[0])), known[1]
    keys, pairs, contexts, ones, words = (Places(x) for x in (s.key, s.pair_key, s.ctx, s.ones, s.words))
    own1 = np.where(np.isnan(s.p1), at_or(p_known, known.find(s.words), np.nan), s.p1)
    seen2 = s.own2 + s.weight2[s.pair_one] * own1[s.pair_word]
    seen3 = np.log10(s.own3 + s.weight3[s.row_ctx] * seen2[s.row_pair])
    out = []
    for src, data in got[GRAMS]:
        one, context, word, row = read(data)
        at = keys.find(pair_of(context, word))
        value = at_or(seen3, at, 0.0)
        new = np.flatnonzero(at < 0)
        one, context, word = one[new], context[new], word[new]
        at_ctx, at_one = contexts.find(context), ones.find(one)
        p1 = at_or(own1, words.find(word), np.nan)
        open_ = np.flatnonzero(np.isnan(p1))
        p1[open_] = at_or(p_known, known.find(word[open_]), np.nan)
        lacks = np.isnan(p1)  # not seen after ``one``, so the shares are none and the logarithm is added later
        p2 = at_or(s.own2, pairs.find(pair_of(one, word + np.uint64(2))), 0.0)
        p2 = p2 + at_or(s.weight2, at_one, 1.0) * np.where(lacks, 1.0, p1)
        value[new] = np.log10(at_or(s.weight3, at_ctx, 1.0) * p2)
        rows, place = np.unique(row, return_inverse=True)
        out.append((src, SUMS, 0, 0.0, pickle.dumps((rows, np.bincount(place, value, len(rows))), 5)))
        split = dealer.split(one)  # restaurants that other parts may have
        asks = [(word, lacks), (context, split & (at_ctx < 0)), (one, split & (at_one < 0))]
        row, key = (np.concatenate(c) for c in zip(*((row[new[m]], k[m]) for k, m in asks)))
        if len(row):
            out.append((src, REST, 0, 0.0, pickle.dumps((row, key, np.concatenate([np.full(m.sum(), i > 0) for i, (_, m) in enumerate(asks)])), 5)))
    return out

"""Byte-pair encoding and decoding with a published vocabulary, by batched merge rounds.

The symbols of many distinct words lie in one flat array.  Each round looks up all neighbouring
pairs at once by binary search over the sorted pair keys, finds the lowest rank in every word, and
merges its places.  A word leaves when no pair of it is known.  Each token of the vocabulary is the
product of one merge only, so this gives what merging one place at a time gives.

Texts are taken whole.  Null and empty texts give no ids and decode to the empty text.  Rows are
handled one by one: repeated or null ids, ties, empty tables and other columns do not matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import bounded_batches, pieces, whole_texts

#: Distinct words whose ids a worker remembers; then it starts anew.
REMEMBERED = 100_000
#: Bytes of text encoded at a time.
AT_ONCE = 1 << 20
NO_RANK = np.int64(1) << 60

# The white space of Unicode and the word pattern of the published tokenizer.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
# Letters and numbers newer than Unicode 16, the version of the tokenizers library,
# which are neither for it, and lower cases of Unicode 16 and 17 that this Python may lack.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f "
    "12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f"
)
LOWER = {
    0x3A3: 0x3C3,  # by character, so without the final form of sigma
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
NEWER_CLASS = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
HAS_NEWER = re.compile(f"[{NEWER_CLASS}]")
HAS_LOWER = re.compile(f"[{''.join(map(chr, LOWER))}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tokens by id, the symbols of bytes, and the merges sorted by pair key."""

    tokens: list[str]
    special: dict[str, int]
    inner: np.ndarray  # id of each byte within a word
    last: np.ndarray  # id of each byte at the end of a word
    pair_keys: np.ndarray  # left id * 2^32 + right id, ascending
    pair_ranks: np.ndarray
    pair_products: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in {**ids, **special}.items():
            tokens[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        products = np.array([ids[a + b] for a, b in merges], np.int64)
        if len(set(products.tolist())) != len(products):
            raise ValueError("a token of this vocabulary is the product of several merges")
        keys = (left << 32) | right
        order = np.argsort(keys)
        symbols = byte_symbols()
        return cls(
            tokens, special,
            np.array([ids[s] for s in symbols], np.int64),
            np.array([ids[s + suffix] for s in symbols], np.int64),
            keys[order], order.astype(np.int64), products[order],
        )

    @cached_property
    def words(self) -> regex.Pattern:
        return regex.compile(WORDS)

    @cached_property
    def words_beside_newer(self) -> regex.Pattern:
        letters, numbers = (rf"[\p{{{k}}}--[{NEWER_CLASS}]]" for k in "LN")
        others = rf"[^{SPACE}{letters}{numbers}]+"
        contractions = WORDS.partition(r"|[\p{L}]")[0]
        return regex.compile(f"{contractions}|{letters}+|{numbers}|{others}", regex.V1)

    @cached_property
    def specials(self) -> regex.Pattern | None:
        longest_first = sorted(self.special, key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, longest_first))) if self.special else None

    @cached_property
    def table(self) -> pa.Array:
        return pa.array(self.tokens, pa.string())


def merge_rounds(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and how many ids each word has.

    A pair is looked up when it comes about; each round looks up the pairs beside its merges only.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    symbols = vocab.inner[flat]
    ends = np.cumsum(sizes) - 1
    symbols[ends] = vocab.last[flat[ends]]
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat))  # where a symbol began: places keep the order of finished words
    ranks, products = np.full(len(flat), NO_RANK), np.zeros(len(flat), np.int64)

    def look_up(left: np.ndarray) -> None:
        """Rank and product of the pairs that begin at ``left``."""
        left = left[left + 1 < len(symbols)]
        keys = (symbols[left] << 32) | symbols[left + 1]
        at = np.minimum(np.searchsorted(vocab.pair_keys, keys), len(vocab.pair_keys) - 1)
        known = (vocab.pair_keys[at] == keys) & (word[left] == word[left + 1])
        ranks[left] = np.where(known, vocab.pair_ranks[at], NO_RANK)
        products[left] = vocab.pair_products[at]

    look_up(np.arange(len(flat)))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lowest = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(word))))
        active = lowest < NO_RANK
        if not active.all():
            done.append((symbols[~active], word[~active], place[~active]))
            symbols, word, place, ranks, products, lowest = (
                x[active] for x in (symbols, word, place, ranks, products, lowest)
            )
            if not len(symbols):
                break
        chosen = np.flatnonzero(ranks == lowest)
        # Of places that overlap (the same symbol three times or more) every second one is merged.
        run = np.append(True, np.diff(chosen) > 1)
        first = chosen[np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))]
        chosen = chosen[(chosen - first) % 2 == 0]
        symbols[chosen] = products[chosen]
        ranks[chosen] = NO_RANK  # unless there is a next symbol
        rest = np.ones(len(symbols), bool)
        rest[chosen + 1] = False
        merged = chosen - np.arange(len(chosen))  # where they are once the others are gone
        symbols, word, place, ranks, products = (x[rest] for x in (symbols, word, place, ranks, products))
        look_up(np.unique(np.concatenate([merged, merged[merged > 0] - 1])))
    symbols, word, place = (np.concatenate(x) for x in zip(*done))
    return symbols[np.argsort(place)].astype(np.uint32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes batches of texts and remembers the ids of words it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a word's ids in ``ids``
        self.ids = np.zeros(0, np.uint32)

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens stay as they are, marked by a leading line break."""
        found: list[str] = []
        at = 0
        for m in self.vocab.specials.finditer(text) if self.vocab.specials and "<|" in text else ():
            found += self._plain(text[at : m.start()])
            found.append("\n" + m.group())  # no word holds white space
            at = m.end()
        return found + self._plain(text[at:]) if at else self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.vocab.words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if _is_latin(text):  # then none of the characters that need care is there
            return self.vocab.words.findall(text.lower())
        if HAS_LOWER.search(text):
            text = text.translate(LOWER)
        text = text.lower()
        words = self.vocab.words_beside_newer if HAS_NEWER.search(text) else self.vocab.words
        return words.findall(text)

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        special = [w for w in new if w[0] == "\n"]
        plain = [w for w in new if w[0] != "\n"]
        ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if plain:
            ids, sizes = merge_rounds([w.encode() for w in plain], self.vocab)
        ids = np.append(ids, np.array([self.vocab.special[w[1:]] for w in special], np.uint32))
        sizes = np.append(sizes, np.ones(len(special), np.int64))
        self.known.update(zip([*plain, *special], range(len(self.known), len(self.known) + len(new))))
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        coded = pa.array([w for ws in split for w in ws], pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if not words:
            return [b""] * len(texts)
        self.learn(words)
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = self.size[code]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[code] - (ends - sizes), sizes)]
        per_text = np.append(0, ends)[np.cumsum([0, *(len(ws) for ws in split)])]
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(per_text[:-1], per_text[1:])]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _decode(packed: pa.Array, vocab: Vocabulary) -> pa.Array:
    """Tokens of the ids with a space between them, as there is no decoder for word ends."""
    packed = pc.fill_null(packed.cast(pa.binary()), b"")
    counts = pc.binary_length(packed).to_numpy() // 4
    joined = b"".join(packed.to_pylist())
    tokens = vocab.table.take(pa.array(np.frombuffer(joined, "<u4")))
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")


class Tokenizer:
    """Columns of ids and of texts for one vocabulary file, which is read on the driver alone."""

    def __init__(self, spark: SparkSession, path: str):
        bounded_batches(spark)
        self.held = spark.sparkContext.broadcast(Vocabulary.read(path))  # of the size of the file

    def encode(self, text: Column) -> Column:
        """Binary: the ids of a text as little-endian unsigned 32-bit integers."""
        held = self.held

        def encoded(parts):
            encoder = Encoder(held.value)
            for texts in parts:
                ids = [x for p in pieces(whole_texts(texts), AT_ONCE) for x in encoder.encode(p.to_pylist())]
                yield pa.array(ids, pa.binary())

        return F.arrow_udf(_iterator(encoded), T.BinaryType()).asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        """The text of such ids."""
        held = self.held

        def decoded(parts):
            for packed in parts:
                done = [_decode(p, held.value) for p in _cut(packed)]
                yield pa.concat_arrays([d.cast(pa.string()) for d in done])

        return F.arrow_udf(_iterator(decoded), T.StringType()).asNondeterministic()(ids)


    def round_trip(self, text: Column) -> Column:
        """Struct of ids and of the text they decode to, by one function and so one worker a task."""
        held = self.held

        def both(parts):
            encoder = Encoder(held.value)
            for texts in parts:
                done = []
                for piece in pieces(whole_texts(texts), AT_ONCE):
                    ids = pa.array(encoder.encode(piece.to_pylist()), pa.binary())
                    decoded = [_decode(p, held.value).cast(pa.string()) for p in _cut(ids)]
                    done.append(pa.StructArray.from_arrays([ids, pa.concat_arrays(decoded)], ["ids", "decoded"]))
                yield pa.concat_arrays(done)

        kind = "struct<ids: binary, decoded: string>"
        return F.arrow_udf(_iterator(both), kind).asNondeterministic()(text)


def _cut(packed: pa.Array) -> list[pa.Array]:
    return list(pieces(pc.fill_null(packed, b""), AT_ONCE))


def _iterator(f):
    """Spark tells the kind of an Arrow function by its annotations."""
    from collections.abc import Iterator

    f.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, packed ids and decoded text of every row of ``docs``."""
    tokenizer = Tokenizer(docs.sparkSession, path)
    rows = docs.select("doc_id", tokenizer.round_trip(F.col("text")).alias("both"))
    return rows.select("doc_id", "both.ids", "both.decoded")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Counts and hashes of what ``encode_documents`` gives, with further columns of it."""
    return encoded.select(
        "doc_id", *more,
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

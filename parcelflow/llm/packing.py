"""Packing of token sequences by minimum bin slack, on counts of lengths.

Pieces of one length are alike to the packing, so it works on how many pieces of each length there are: at most
as many numbers as a bin has tokens, whatever the corpus.  For every bin, a subset-sum table in bits over the
lengths that are left finds the fullest combination, larger lengths first among equally full ones, and the
combination is taken as often as the counts allow.  Taking it so often at least halves the count of some length, so
the number of steps is bounded by the size of a bin as well.  Two orders of search are packed, the fullest
combination of all and the fullest one that holds the longest piece that is left, and the one with fewer bins counts.

Pieces are dealt to bins on the executors: a piece has a place among those of its length (by ranges, so a length that
very many pieces have lies in many tasks), and the steps, a table bounded as above, say which bin and offset it has.

Texts are encoded whole, cut only at ASCII white space, which no token crosses.  Null and empty texts are the end
mark alone.  Repeated ids and rows are packed each on its own, their order among equals is any; other columns do
not matter, and an empty table packs to no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parcelflow.staging import stage

from .bpe import byte_symbols
from .common import bounded_batches, pieces, whole_texts
from .places import places

#: Tokens of a sequence.
CAPACITY = 2048
#: Distinct words (of ten ids each) that a worker remembers; then it starts anew.
REMEMBERED = 500_000
#: Bytes of text encoded at a time; a word is looked up once in them.
AT_ONCE = 4 << 20
# Characters whose lower case and kind need no tables, and the parts of words of the tokenizer.
PLAIN = re.compile("[!-~À-ÿ]+")
LETTERS = "a-zß-öø-ÿ"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+|\n")
#: The signs that stand for bytes in byte-level vocabularies.
BYTE_SIGNS = str.maketrans(dict(enumerate(byte_symbols())))


class _Known:
    """Ids of keys, end to end in one array."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def add(self, keys: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys))))
        self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, flat)

    def add_lists(self, keys: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.add(keys, sizes, np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())))

    def places(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys at ``places``, end to end, and where each key's end."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        starts = (np.cumsum(self.sizes) - self.sizes)[places] - (ends - sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts, sizes)], ends


class WordIds:
    """Ids of texts by the tokenizers library, which sees each distinct word of a piece once.

    The library spends most of its time on normalising.  Words of plain and accented Latin characters need lower
    case and a split into letters, digits and signs only, so their parts go straight to the library's model; words with
    any other character, or with the mark of special tokens, go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.words, self.parts = _Known(), _Known()
        self.parts.add_lists(["\n"], [[]])  # ends a word

    def _learn_plain(self, words: list[str]) -> None:
        parts = PARTS.findall("".join(f"{w}\n" for w in words).lower())
        new = list(set(parts) - self.parts.place.keys())
        if new:
            # All parts are written in the signs of their bytes at once.
            signs = "\n".join(new).encode().decode("latin-1").translate(BYTE_SIGNS).split(BYTE_SIGNS[10])
            tokenize = self.tokenizer.model.tokenize
            self.parts.add_lists(new, [[t.id for t in tokenize(part)] for part in signs])
        places = self.parts.places(parts)
        flat, ends = self.parts.gathered(places)
        last = ends[places == 0]
        self.words.add(words, np.diff(last, prepend=0), flat)

    def _places(self, words: list[str]) -> np.ndarray:
        if max(len(self.words.place), len(self.words.flat) // 10) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.words.place]
        plain = [w for w in new if PLAIN.fullmatch(w) and "<|" not in w]
        if plain:
            self._learn_plain(plain)
        odd = [w for w in new if w not in self.words.place]
        if odd:
            found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            self.words.add_lists(odd, [e.ids for e in found])
        return self.words.places(words)

    def of_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text; no word reaches over white space, so words are encoded on their own."""
        split = pc.ascii_split_whitespace(texts)
        words, text = split.flatten().dictionary_encode(), pc.list_parent_indices(split).to_numpy()
        places = self._places(words.dictionary.to_pylist())
        whole, ends = self.words.gathered(places[words.indices.to_numpy(zero_copy_only=False)])
        at = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(len(texts) + 1))]
        for i in range(len(texts)):
            yield whole[at[i]:at[i + 1]]


def piece_rows(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each document and an end mark, cut after ``capacity``."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(path)
        for batch in batches:
            done = 0
            for texts in pieces(whole_texts(batch.column("text")), AT_ONCE):
                rows = []
                for number, ids in enumerate(encoder.of_texts(texts), done):
                    ids = np.append(ids, np.array([end], "<u4"))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start:start + capacity]
                        rows.append((number, piece, start, len(part), crc32(part.tobytes())))
                done += len(texts)
                of, *columns = (pa.array(c, t) for c, t in zip(zip(*rows), KINDS)) if rows else _none()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), *columns], NAMES)

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, "
             "ids_crc32 bigint"
    )


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _none() -> list[pa.Array]:
    return [pa.array([], k) for k in KINDS]


@dataclass(frozen=True)
class Step:
    """``times`` bins that hold ``counts`` pieces of each length."""

    counts: dict[int, int]
    times: int


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths in ``left`` that fills ``room`` best, longer ones first.

    Bit s of a table is set if the lengths so far can fill s; counts enter by powers of two.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    table, taken = 1, []
    for length in sorted((n for n in left if n <= room), reverse=True):
        many, size = min(left[length], room // length), 1
        while many:
            size = min(size, many)
            taken.append((length, size, table))
            table |= (table << (length * size)) & mask
            many -= size
            size *= 2
        if table & goal:
            break
    at, out = table.bit_length() - 1, Counter()
    for length, size, before in reversed(taken):
        if not before >> at & 1:
            out[length] += size
            at -= length * size
    return dict(out)


def plan(counts: dict[int, int], capacity: int = CAPACITY, longest_first: bool = False) -> list[Step]:
    """Bins for all pieces: the fullest combination, as often as possible, until none is left."""
    left, steps = {n: c for n, c in counts.items() if c}, []
    while left:
        if longest_first:
            seed = max(left)
            rest = {**left, seed: left[seed] - 1}
            chosen = Counter(fullest({n: c for n, c in rest.items() if c}, capacity - seed))
            chosen[seed] += 1
        else:
            chosen = fullest(left, capacity)
        times = min(left[n] // c for n, c in chosen.items())
        steps.append(Step(dict(chosen), times))
        for n, c in chosen.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return steps


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """The plan with fewer bins, of both orders of search."""
    plans = [plan(counts, capacity, longest_first) for longest_first in (False, True)]
    return min(plans, key=lambda steps: sum(s.times for s in steps))


def step_rows(steps: list[Step]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first place, places, first bin, pieces in a bin, offset in a bin) for each length of each step."""
    used, bins, rows = Counter(), 0, []
    for step in steps:
        offset = 0
        for length, each in sorted(step.counts.items(), reverse=True):
            rows.append((length, used[length], each * step.times, bins, each, offset))
            used[length] += each * step.times
            offset += each * length
        bins += step.times
    return rows


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table with ``length``) with the ``sequence_id`` and ``offset`` that the plan gives them."""
    spark = rows.sparkSession
    # One number per length, at most ``capacity`` of them.
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = spark.createDataFrame(
        step_rows(best_plan(counts, capacity)),
        "length bigint, first bigint, n bigint, bin bigint, each bigint, at bigint",
    )
    # Steps of a length as one sorted array, so that a piece meets one row and finds its step by bisection.
    steps = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "bin", "each", "at"))).alias("s"))
    placed = places(rows, ["length"], ["doc_id", "piece"], "_place", "_size")
    met = placed.join(F.broadcast(steps), "length")
    step = F.expr("element_at(filter(s, x -> x.first <= _place), -1)")
    met = met.withColumn("_step", step).withColumn("_own", F.expr("_place - _step.first"))
    return met.select(
        *rows.columns,
        F.expr("_step.bin + _own div _step.each").alias("sequence_id"),
        F.expr("_step.at + _own % _step.each * length").alias("offset"),
    )


def pack(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packed(stage(piece_rows(docs, path, end, capacity), "pieces"), capacity)

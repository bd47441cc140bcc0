"""Long lists of phrases: one automaton finds all of them in one pass over a text.

Short lists stay built-in expressions (``text``, ``guard``); an expression for each of thousands of phrases would read
the text as often.  The automaton is built once in each Python worker.  Where several phrases compete, the one
that stands first in the list wins, as in a chain of replacements in list order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .columns import let

#: Lists longer than this go to the automaton.
MANY = 100


class _Automaton:
    """All phrases by their folded form; of phrases with the same one the first counts."""

    def __init__(self, phrases: list[str]):
        self.phrases, self.built = phrases, None

    def __getstate__(self):
        return {"phrases": self.phrases, "built": None}

    def found(self, text: str):
        """(end, (rank, length)) of every occurrence, overlapping ones too; ``end`` is that of its last character."""
        if self.built is None:
            import ahocorasick

            self.built = ahocorasick.Automaton()
            for rank, phrase in reversed(list(enumerate(self.phrases))):
                if phrase:
                    self.built.add_word(phrase, (rank, len(phrase)))
            self.built.make_automaton()
        return self.built.iter(text) if len(self.built) else iter(())


def _texts(f, kind: str, texts: Column) -> Column:
    def each(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in batch.to_pylist()], ARROW[kind])

    return F.arrow_udf(each, kind)(texts)


ARROW = {"boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}


def holds_any(text: Column, phrases: list[str]) -> Column:
    """Whether a text holds any phrase as it is written; false for null.  An empty phrase is in every text."""
    automaton, always = _Automaton(phrases), "" in phrases
    return F.coalesce(_texts(lambda t: always or next(automaton.found(t), None) is not None, "boolean", text), F.lit(False))


def ranks_of(text: Column, phrases: list[str]) -> Column:
    """The places in the list of all phrases that a text holds as they are written, in list order, each once."""
    first: dict[str, int] = {}
    for rank, phrase in enumerate(phrases):
        first.setdefault(phrase, rank)
    again = [(rank, first[p]) for rank, p in enumerate(phrases) if first[p] != rank]
    automaton, empty = _Automaton(phrases), [r for r, p in enumerate(phrases) if not p]

    def ranks(t: str) -> list[int]:
        held = {rank for _, (rank, _) in automaton.found(t)}
        return sorted({*held, *empty, *(rank for rank, same in again if same in held)})

    return _texts(ranks, "array<int>", text)


def phrases_of(text: Column, phrases: list[str]) -> Column:
    """The phrases that a text holds, in list order; none for null."""
    listed = F.array(*map(F.lit, phrases)) if phrases else F.array().cast("array<string>")
    ranks = F.coalesce(ranks_of(text, phrases), F.array().cast("array<int>"))
    return let(ranks, lambda held: F.transform(held, lambda r: F.get(listed, r)))


def folded(text: str) -> str:
    """A text in which letters that differ in case alone are the same, character by character."""
    if text.isascii():
        return text.lower()
    return "".join(map(_fold, text))


def _fold(c: str) -> str:
    upper = c.upper()
    lower = (upper if len(upper) == 1 else c).lower()
    return lower if len(lower) == 1 else "i" if c == "İ" else c


def _in_word(c: str) -> bool:
    import unicodedata

    return c == "_" or (c.isascii() and c.isalnum()) or unicodedata.category(c)[0] in "LN"


def replace_words(text: Column, phrases: list[str], to: str) -> Column:
    """Every phrase that stands as whole words, in any case, replaced.

    Phrases that overlap in a text compete: the one that stands first in the list is replaced, of its own
    occurrences the leftmost.  That is what a chain of replacements does, if ``to`` has no word of a phrase.
    """
    automaton = _Automaton([folded(p) for p in phrases])

    def replaced(t: str) -> str:
        hits = []
        for end, (rank, length) in automaton.found(folded(t)):
            start, stop = end + 1 - length, end + 1
            if (start == 0 or not _in_word(t[start - 1])) and (stop == len(t) or not _in_word(t[stop])):
                hits.append((rank, start, stop))
        kept: list[tuple[int, int]] = []
        covered = bytearray(len(t)) if hits else b""
        for _, start, stop in sorted(hits):
            if not any(covered[start:stop]):
                covered[start:stop] = b"\x01" * (stop - start)
                kept.append((start, stop))
        out, at = [], 0
        for start, stop in sorted(kept):
            out += [t[at:start], to]
            at = stop
        return "".join([*out, t[at:]])

    return _texts(replaced, "string", text)

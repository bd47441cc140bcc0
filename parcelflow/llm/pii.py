"""Personal data, also when disguised, with spans in the characters of the source.

Plain identifiers are found in the text as it stands.  Then a chain of transducers rewrites
look-alike letters and digits, spelled digits, and "at" / "dot" disguises.  Each transducer keeps
the pieces it rewrote, so a span found in the rewritten text is carried back piece by piece to
characters of the source.  Texts without a sign of disguise are not rewritten.

Null and empty texts have no spans; texts are taken whole.  Rows are handled one by one, so null or
repeated ids, ties, empty tables and other columns do not matter.  Spans are (kind, start, end) in
code points, end exclusive, ordered by start and then by kind; of one text no span repeats.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, span_digests, whole_texts

KINDS = ("email", "ip", "card", "phone")

# --- detectors: (start, end) of identifiers, leftmost and not overlapping -------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that began inside a run of digits would also begin at its first digit, so runs are
# entered there only and long ones cost one pass.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            free = domain.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), ordered."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for kind, detect in enumerate((ips, cards, phones), 1):
            found += [(s, kind, e) for s, e in detect(text)]
    return sorted(found)


# --- transducers ----------------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTYXIJS"))
GREEK = dict(zip("οανιυρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaviupkABEZHIKMNOPTYX"))
FULL_WIDTH = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
DIGIT_SETS = {  # decimal digits of other scripts, circled and mathematical ones
    chr(first + d): str(d)
    for first in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
    for d in range(10)
}
UNSEEN = dict.fromkeys("\xad\u200b\u200c\u200d\u2060\ufeff", "")
SIGNS = {
    "﹫": "@", "․": ".", "。": ".", "\xa0": " ",
    "‐": "-", "‑": "-", "‒": "-", "–": "-",
}
LOOKALIKES = {**CYRILLIC, **GREEK, **FULL_WIDTH, **DIGIT_SETS, **UNSEEN, **SIGNS}
SPELLED = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890"))

LOOKALIKE = re.compile(f"[{re.escape(''.join(LOOKALIKES))}]")
DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
SPELLED_RUN = re.compile(rf"\b(?:plus[ -])?{DIGIT_WORD}(?:[ -]{DIGIT_WORD})+\b", re.I)
#: A sign of spelled digits, to be looked for in lower case.
TWO_DIGIT_WORDS = re.compile(f"{DIGIT_WORD}[ -]{DIGIT_WORD}")
BRACKETED = r"[ ]?[\[({{<][ ]?{0}[ ]?[\])}}>][ ]?"
AT = BRACKETED.format(r"(?:at|@|&#64;|&commat;)")
DOT = BRACKETED.format(r"(?:dot|\.|&#46;|&period;|point)")
LABEL = r"[A-Za-z0-9-]+"
# Endings that an address in plain words must have, as "look at the dot on it" is prose.  Endings of
# countries that are English words (as, be, do, is, me, my, no, so, to ...) are left to prose, but for a few.
ENDINGS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|travel|jobs|museum|coop|aero|online|site|store|shop|tech|cloud|"
    "xyz|blog|email|io|co|ai|app|dev|uk|de|fr|es|it|nl|eu|ch|at|us|ca|au|in|jp|"
    "ac|ad|ae|af|ag|al|ao|aq|ar|aw|ax|az|ba|bb|bd|bf|bg|bh|bi|bj|bm|bn|bo|br|bs|bt|bw|by|bz|cc|cd|cf|cg|ci|ck|cl|cm|cn|"
    "cr|cu|cv|cw|cx|cy|cz|dj|dk|dm|dz|ec|ee|eg|er|et|fi|fj|fk|fm|fo|ga|gd|ge|gf|gg|gh|gi|gl|gm|gn|gp|gq|gr|gs|gt|gu|gw|"
    "gy|hk|hm|hn|hr|ht|hu|id|ie|il|im|iq|ir|je|jm|jo|ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|la|lb|lc|li|lk|lr|ls|lt|lu|lv|ly|"
    "mc|md|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|mx|mz|na|nc|ne|nf|ng|ni|np|nr|nu|nz|om|pe|pf|pg|ph|pk|pl|pm|pn|"
    "pr|ps|pt|pw|py|qa|re|ro|rs|ru|rw|sa|sb|sc|sd|se|sg|sh|si|sk|sl|sm|sn|sr|ss|st|su|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|"
    "tl|tm|tn|tr|tt|tv|tw|tz|ua|ug|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw"
)
ANY_DOT = rf"(?:{DOT}|[ ]dot[ ]|\.)"
#: Plain words count only together: name at host dot end, or with a plain sign name@host dot end.
DISGUISED_EMAIL = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])(?:(?:{AT}|&#64;|&commat;){LABEL}(?:{ANY_DOT}{LABEL})+"
    rf"|@{LABEL}(?:{ANY_DOT}{LABEL})*[ ]dot[ ](?:{ENDINGS})\b(?:{DOT}{LABEL})*"
    rf"|@{LABEL}(?:{ANY_DOT}{LABEL})*{DOT}{LABEL}(?:(?:{DOT}|\.){LABEL})*"
    rf"|[ ]at[ ]{LABEL}(?:{ANY_DOT}{LABEL})*(?:{DOT}|[ ]dot[ ])(?:{ENDINGS})\b)",
    re.I,
)
AT_SIGN = re.compile(rf"(?:{AT}|&#64;|&commat;|[ ]at[ ])", re.I)
DOT_SIGN = re.compile(rf"(?:{DOT}|[ ]dot[ ])", re.I)
DISGUISED_DOT = re.compile(rf"(?<=[0-9])(?:{DOT}|[ ]dot[ ])(?=[0-9])", re.I)
DISGUISED_LOCAL = re.compile(
    rf"(?<=[A-Za-z0-9])(?:{DOT}|[ ]dot[ ])(?=[A-Za-z0-9]+(?:{AT}|[ ]at[ ]|@))", re.I
)


@dataclass
class Rewritten:
    """A rewritten text with its pieces: where each begins there, and what it stands for here."""

    text: str
    begins: list[int]
    sources: list[tuple[int, int, bool]]  # start and end in the source, whether it was rewritten

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span of the rewritten text stands for."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        i = bisect_right(self.begins, at) - 1
        begin, (start, end, changed) = self.begins[i], self.sources[i]
        return (start, end) if changed else (start + at - begin, start + at - begin + 1)


def rewrite(text: str, rules: list[tuple[re.Pattern, Callable[[str], str]]]) -> Rewritten:
    """Replace every match of the patterns; of overlapping ones the first stays."""
    found = sorted((m.start(), m.end(), to(m.group())) for p, to in rules for m in p.finditer(text))
    out, begins, sources, at, size = [], [], [], 0, 0
    for start, end, new in [*found, (len(text), len(text), "")]:
        if start < at:
            continue
        for piece, source in ((text[at:start], (at, start, False)), (new, (start, end, True))):
            if piece:
                out.append(piece)
                begins.append(size)
                sources.append(source)
                size += len(piece)
        at = end
    return Rewritten("".join(out), begins, sources)


def _digits(run: str) -> str:
    words = re.split("[ -]", run.lower())
    return "".join("+" if w == "plus" else SPELLED[w] for w in words)


def _address(run: str) -> str:
    return DOT_SIGN.sub(".", run if run[0] == "@" else AT_SIGN.sub("@", run, count=1))


def _folds(text: str) -> bool:
    return not text.isascii() and LOOKALIKE.search(text) is not None


def _spells(text: str) -> bool:
    return TWO_DIGIT_WORDS.search(text.lower()) is not None


def _has_signs(text: str) -> bool:
    return any(c in text for c in "[({<&") or "dot" in text.lower()


#: The chain: a cheap test that passes wherever a pattern can match, and what to rewrite.
CHAIN = [
    (_folds, [(LOOKALIKE, LOOKALIKES.get)]),
    (_spells, [(SPELLED_RUN, _digits)]),
    (_has_signs, [(DISGUISED_DOT, lambda _: "."), (DISGUISED_LOCAL, lambda _: ".")]),
    (_has_signs, [(DISGUISED_EMAIL, _address)]),
]


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Identifiers of the rewritten text as (start, kind, end) of the source."""
    steps: list[Rewritten] = []
    now = text
    for may_match, rules in CHAIN:
        if may_match(now) and any(p.search(now) for p, _ in rules):
            steps.append(rewrite(now, rules))
            now = steps[-1].text
    if not steps:
        return []
    found = set()
    for start, kind, end in identifiers(now):
        for step in reversed(steps):
            start, end = step.back(start, end)
        found.add((start, kind, end))
    return sorted(found)


def spans(text: str) -> list[dict]:
    """All spans: the plain ones, and disguised ones that do not lie within a plain one of the kind."""
    plain = identifiers(text)
    inside = lambda s, k, e: any(a <= s and e <= b for a, x, b in plain if x == k)
    added = [x for x in disguised(text) if not inside(*x)]
    return [
        {"kind": KINDS[k], "start": s, "end": e, "plain": p}
        for (s, k, e), p in sorted([*((x, True) for x in plain), *((x, False) for x in added)])
    ]


SPANS = "array<struct<kind: string, start: bigint, end: bigint, plain: boolean>>"
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
)


def _found(texts: pa.Array) -> pa.Array:
    return pa.array([spans(t) for t in whole_texts(texts).to_pylist()], ARROW_SPANS)


def find(text: Column) -> Column:
    """Array of (kind, start, end, plain) of a text."""
    return F.arrow_udf(_found, SPANS).asNondeterministic()(text)  # so that it is not repeated


def _masked(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for text, marks in zip(texts.to_pylist(), found.to_pylist()):
        parts, at = [], 0
        for m in marks or ():
            if m["end"] > at:
                parts += [text[at : max(at, m["start"])], f"<{m['kind']}>" if m["start"] >= at else ""]
                at = m["end"]
        out.append(text if text is None else "".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


def mask(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind; of spans that overlap the first gives the kind."""
    return F.arrow_udf(_masked, "string")(text, found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", find(F.col("text")).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of plain spans by kind, the hash of the plain ones, all spans as text."""
    return found.select("doc_id", *span_digests(F.col("spans"), KINDS))

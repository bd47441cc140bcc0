"""Secret scan with an inverted index of trigrams.

Each rule's regular expression gives a Boolean query of trigrams that every match must hold, in lower
case: a choice of sets, one of which must be there whole.  The index has a posting (trigram, row key)
for each trigram of the queries that a text holds.  Postings are intersected by counting them per set
and row; the rows left are candidates, and only they meet the rule's expression.  A rule whose
expression guarantees no trigram is tried on every text.

A row's key is a hash of its id and text.  Rows that share a key become candidates together, which
costs a needless look and changes no result.

Null and empty texts have no spans; texts are taken whole.  Null or repeated ids, equal rows and
empty tables give one row out for each row in; other columns are not looked at.  Spans are (kind,
start, end) in code points, end exclusive, ordered by start and then by kind.
"""

from __future__ import annotations

import re._constants as kinds_of
import re._parser as expressions
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.staging import stage

from .common import maybe_broadcast

#: A part of an expression stands for at most so many strings, else it guarantees nothing.
STRINGS = 48


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    ``sign`` is found in every text that holds such a match; it spares the spans of all others.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    sign: str | None = None


# The patterns of the base kinds and of well-known token formats.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, sign=r"[0-9a-f]{32}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{0,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = (*BASE, *ADDED)

# --- trigram queries: sets of trigrams, any of which must be there whole ---------------------------

Query = frozenset  # of frozensets of trigrams
NOTHING: Query = frozenset([frozenset()])  # guarantees nothing


def _simplest(sets) -> Query:
    sets = set(sets)
    return Query(s for s in sets if not any(t < s for t in sets))


def _both(a: Query, b: Query) -> Query:
    return _simplest(x | y for x in a for y in b)


def _of_strings(strings: set[str]) -> Query:
    return _simplest(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _joined(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= STRINGS else None


def _characters(items) -> set[str] | None:
    """The characters of a class in lower case, if they are few."""
    found: set[str] = set()
    for op, arg in items:
        if op is kinds_of.LITERAL:
            found.add(chr(arg).lower())
        elif op is kinds_of.RANGE and arg[1] - arg[0] < STRINGS:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 6 else None


def _part(op, arg) -> tuple[set[str] | None, Query]:
    """All strings of one part of an expression if they are few, and what its matches must hold."""
    if op is kinds_of.LITERAL:
        return {chr(arg).lower()}, NOTHING
    if op is kinds_of.IN:
        return _characters(arg), NOTHING
    if op is kinds_of.SUBPATTERN:
        return _sequence(arg[-1])
    if op is kinds_of.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*[s for s, _ in parts])
            if len(strings) <= STRINGS:
                return strings, NOTHING
        return None, _simplest(x for s, q in parts for x in (_of_strings(s) if s is not None else q))
    if op in (kinds_of.MAX_REPEAT, kinds_of.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, NOTHING
        if strings is not None and low == high and low <= 8:
            out: set[str] | None = {""}
            for _ in range(low):
                out = out and _joined(out, strings)
            if out:
                return out, NOTHING
        if low == 0:
            return None, NOTHING
        return None, _of_strings(strings) if strings is not None else query
    return None, NOTHING  # any character, class of characters, anchor: no promise


def _sequence(parts) -> tuple[set[str] | None, Query]:
    strings: set[str] | None = {""}
    query, whole = NOTHING, True
    for op, arg in parts:
        own, needs = _part(op, arg)
        longer = None if own is None or strings is None else _joined(strings, own)
        if longer is None:  # a run of known strings ends here
            query = _both(query, _of_strings(strings or {""}))
            whole, longer = False, own if own is not None else {""}
        strings, query = longer, _both(query, needs)
    return (strings, query) if whole else (None, _both(query, _of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """What every match of an expression holds, in lower case; NOTHING if there is no promise."""
    strings, query = _sequence(expressions.parse(pattern))
    return _of_strings(strings) if strings is not None else query


# --- index, candidates, verification ---------------------------------------------------------------


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for s in trigram_query(r.pattern) for g in s})


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the given trigrams in the lower-cased texts."""
    low = docs.select(row_key().alias("key"), F.lower("text").alias("low"))
    held = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    return low.select("key", F.explode(F.array_compact(F.array(*held))).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the rules, as bits, whose query the postings of a row satisfy."""
    spark = index.sparkSession
    sets = [
        (i, n, g, len(s))
        for i, rule in enumerate(rules)
        for n, s in enumerate(sorted(map(sorted, trigram_query(rule.pattern))))
        for g in s
    ]
    wanted = spark.createDataFrame(sets, "rule int, term int, trigram string, size int")  # of the rules' size
    found = index.join(F.broadcast(wanted), "trigram").groupBy("key", "rule", "term", "size")
    whole = found.agg(F.countDistinct("trigram").alias("n")).filter("n = size")
    return whole.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def match_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, from their lengths and those of what lies between."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("long"),
        F.transform(measured, F.length).alias("measured"),
    )
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def step(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + x["gap"]
        end = start + F.coalesce(x["long"], F.lit(0))  # after the last gap comes no match
        span = F.struct(start.alias("start"), end.alias("end"))
        kept = F.when(
            x["measured"] >= rule.least, F.concat(so_far["spans"], F.array(span))
        ).otherwise(so_far["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
    return F.aggregate(lengths, start, step, lambda end: end["spans"])


def verify(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...], plain: int) -> DataFrame:
    """doc_id and spans: every rule is tried where the row is a candidate, or has no query."""
    own = docs.select("doc_id", "text", row_key().alias("key"))
    rows = own.join(maybe_broadcast(found), "key", "left")
    text, bits = F.col("text"), F.coalesce("rules", F.lit(0).cast("bigint"))
    per_rule = []
    for i, rule in enumerate(rules):
        everywhere = trigram_query(rule.pattern) == NOTHING
        tried = text.rlike(rule.sign or rule.pattern) if everywhere else bits.bitwiseAND(F.lit(1 << i)) != 0
        per_rule.append(_numbered(F.when(tried, match_spans(text, rule)), i))
    spans = F.array_sort(F.concat(*per_rule))
    names = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform(
        spans,
        lambda s: F.struct(
            F.get(names, s["rule"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (s["rule"] < plain).alias("plain"),
        ),
    )
    return rows.select("doc_id", named.alias("spans"))


def _numbered(spans: Column, rule: int) -> Column:
    none = F.array().cast("array<struct<start: bigint, rule: int, end: bigint>>")
    numbered = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rule).alias("rule"), s["end"].alias("end"))
    )
    return F.coalesce(numbered, none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, plain: int = len(BASE)) -> DataFrame:
    """doc_id and spans (kind, start, end, plain) of every row; the first ``plain`` rules are plain."""
    index = stage(build_index(docs, trigrams(rules)), "postings")
    return verify(docs, stage(candidates(index, rules), "candidates"), rules, plain)

"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; what it measured and whether it failed (one bit per
rule) are stored.  Policies are versioned sets of rules over those bits, so a new policy, or the
effect of leaving a rule out, needs no second look at the texts.

Null and empty texts have no words: all measurements are 0 and the rule on too few words fails.
Rows are judged one by one, so null or repeated ids, ties and empty tables need nothing special, and
columns of the input with the same names as the ledger's are only carried by ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches, fresh_name, pieces, whole_texts, words_of

MEASUREMENTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "longest_word",
]
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` of the measurements (numpy arrays by name) is true."""

    name: str
    fails: object
    limit: float


#: The order gives the bits; append only, so that stored ledgers stay readable.
RULES = [
    Rule("too_few_words", lambda m, x: m["n_words"] < x, 50),
    Rule("repeated_windows", lambda m, x: 100 * m["n_repeat_words"] > x * m["n_words"], 50),
    Rule("too_many_words", lambda m, x: m["n_words"] > x, 1_000_000),
    Rule("short_mean_word", lambda m, x: m["word_chars"] < x * m["n_words"], 2.0),
    Rule("long_mean_word", lambda m, x: m["word_chars"] > x * m["n_words"], 15.0),
    Rule("symbols", lambda m, x: m["n_symbols"] > x * m["n_words"], 0.2),
    Rule("duplicate_lines", lambda m, x: m["n_dup_lines"] > x * m["n_lines"], 0.5),
    Rule("bullet_lines", lambda m, x: m["n_bullet_lines"] > x * m["n_lines"], 0.9),
    Rule("ellipsis_lines", lambda m, x: m["n_ellipsis_lines"] > x * m["n_lines"], 0.5),
    Rule("few_letter_words", lambda m, x: m["n_letter_words"] < x * m["n_words"], 0.6),
    Rule("giant_word", lambda m, x: m["longest_word"] > x, 1_000),
]
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Reject on any rule of ``hard``, or on more than ``allowed`` rules of ``soft``."""

    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0

    def masks(self) -> tuple[int, int]:
        return tuple(reduce(int.__or__, (BITS[r] for r in names), 0) for names in (self.hard, self.soft))

    def keeps(self, bits: Column) -> Column:
        hard, soft = self.masks()
        few = F.bit_count(bits.bitwiseAND(F.lit(soft))) <= self.allowed
        return (bits.bitwiseAND(F.lit(hard)) == 0) & few


#: Versioned: a change of mind is a new version, old ones stay.
POLICIES = {
    "base": Policy(hard=BASE),
    "v1": Policy(
        hard=(*BASE, "symbols", "duplicate_lines", "few_letter_words"),
        soft=("short_mean_word", "long_mean_word", "bullet_lines", "ellipsis_lines", "giant_word"),
        allowed=1,
    ),
}
CURRENT = "v1"


def _sums(groups: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n).astype(np.int64)


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Every measurement for every text of a piece."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in MEASUREMENTS}

    bytes_of = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    before = np.concatenate(([0], np.cumsum(np.isin(bytes_of[ends[0] : ends[-1]], list(SYMBOLS)))))
    out["n_symbols"] = np.diff(before[ends - ends[0]])

    words, doc = words_of(texts)
    coded = words.dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    length = pc.utf8_length(known).to_numpy().astype(np.int64)
    lettered = pc.match_substring_regex(known, r"\pL").to_numpy(zero_copy_only=False)
    out["n_words"] = _sums(doc, n)
    out["word_chars"] = _sums(doc, n, length[code])
    out["n_letter_words"] = _sums(doc, n, lettered[code])
    np.maximum.at(out["longest_word"], doc, length[code])
    out["n_repeat_words"] = _repeat_words(code, len(known), doc, n)

    split = pc.split_pattern(texts, "\n")
    lines, doc = split.flatten(), pc.list_parent_indices(split).to_numpy()
    bare = pc.ascii_trim_whitespace(lines)
    real = pc.greater(pc.binary_length(bare), 0)
    lines, bare, doc = lines.filter(real), bare.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    out["n_lines"] = _sums(doc, n)
    out["n_bullet_lines"] = _sums(doc, n, _true(pc.match_substring_regex(bare, r"^[-*\x{2022}]")))
    out["n_ellipsis_lines"] = _sums(doc, n, _true(pc.match_substring_regex(bare, r"(\x{2026}|\.\.\.)$")))
    code = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    apart = pc.unique(pa.array(doc.astype(np.int64) * (len(lines) + 1) + code)).to_numpy()
    out["n_dup_lines"] = out["n_lines"] - _sums(apart // (len(lines) + 1), n)
    return out


def _coded(values: np.ndarray) -> np.ndarray:
    """A small code for each distinct value."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def _true(flags: pa.Array) -> np.ndarray:
    return flags.to_numpy(zero_copy_only=False)


def _repeat_words(code: np.ndarray, known: int, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in that text."""
    if len(code) < 3:
        return np.zeros(n, np.int64)
    pair = _coded(code[:-2] * known + code[1:-1])
    window = _coded(pair * known + code[2:])
    inside = doc[:-2] == doc[2:]
    own = _coded(window[inside] * n + doc[:-2][inside])
    repeated = np.zeros(len(code), bool)
    repeated[np.flatnonzero(inside)] = np.bincount(own)[own] > 1 if len(own) else False
    covered = repeated.copy()
    covered[1:] |= repeated[:-1]
    covered[2:] |= repeated[:-2]
    return _sums(doc, n, covered)


def _ledger(texts: pa.Array) -> pa.Array:
    found = [_measure(p) for p in pieces(whole_texts(texts))]
    m = {k: np.concatenate([f[k] for f in found]) for k in MEASUREMENTS}
    bits = np.zeros(len(m["n_words"]), np.int64)
    for rule in RULES:
        bits |= np.where(rule.fails(m, rule.limit), BITS[rule.name], 0)
    return pa.StructArray.from_arrays(
        [*(pa.array(m[k], pa.int64()) for k in MEASUREMENTS), pa.array(bits, pa.int64())],
        [*MEASUREMENTS, "fail_bits"],
    )


LEDGER = T.StructType([T.StructField(k, T.LongType()) for k in [*MEASUREMENTS, "fail_bits"]])


def evaluate(text: Column) -> Column:
    """Struct of all measurements and ``fail_bits`` of a text; each text is read once."""
    return F.arrow_udf(_ledger, LEDGER).asNondeterministic()(text)  # so that it is not repeated


def ledger(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per row of ``docs``: id, measurements, failure bits, and the policy's verdict."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", evaluate(F.col("text")).alias("m")).select("doc_id", "m.*")
    return rows.withColumn("base_failed", ~POLICIES["base"].keeps(F.col("fail_bits"))).withColumn(
        "kept", POLICIES[policy].keeps(F.col("fail_bits"))
    )


def judge(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs``, columns as they are, that the policy keeps."""
    bounded_batches(docs.sparkSession)
    m = fresh_name(docs, "ledger")
    marked = docs.withColumn(m, evaluate(F.col("text")))
    return marked.filter(POLICIES[policy].keeps(F.col(f"{m}.fail_bits"))).drop(m)


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents kept if it were left out.

    Rows with the same bits are counted first; what is left has at most one row per set of rules.
    """
    rule = POLICIES[policy]
    by_bits = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    parts = []
    for name in (*rule.hard, *rule.soft):
        without = Policy(
            tuple(r for r in rule.hard if r != name), tuple(r for r in rule.soft if r != name), rule.allowed
        )
        bits, bit = F.col("fail_bits"), F.lit(BITS[name])
        parts.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.when(bits.bitwiseAND(bit) != 0, F.col("n")).otherwise(0).alias("fails"),
                F.when(rule.keeps(bits), F.col("n")).otherwise(0).alias("kept"),
                F.when(without.keeps(bits), F.col("n")).otherwise(0).alias("kept_without"),
            )
        )
    per_rule = by_bits.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return per_rule.groupBy("rule").agg(
        F.sum("fails").alias("fails"),
        F.sum("kept").alias("kept"),
        F.sum("kept_without").alias("kept_without"),
    )

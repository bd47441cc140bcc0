"""Text cleaning: Column -> Column functions, each of which uses its input column once.

Single use matters: the functions are composed into long chains, and an expression that repeats
its input would double the tree at every step.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .columns import let
from .patterns import (
    BOUNDARY, D, END, NOT_S, NOT_W, S, W, WORD_END, WORD_START, WS, WS_CHARS, quote, quote_replacement,
    run_but_one_space, starts_with_any, word,
)
from .phrases import MANY, folded, holds_any, replace_words

# --- fixed values -------------------------------------------------------------------------------
EMAIL_MARK = "[REDACTED_EMAIL]"
PHONE_MARK = "[REDACTED_PHONE]"
ORDER_MARK = "[REDACTED_ORDER]"

EMAIL = BOUNDARY + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + WORD_END
# The lookaheads only skip positions where the pattern could not start.
PHONE = (
    rf"(?=(?:\+|[{WS}-]?\(?){D})"
    rf"(?:(?:\+?{D}{{1,3}})?[{WS}-]?)?(?:\(?{D}{{2,4}}\)?[{WS}-]?)?{D}{{3,4}}[{WS}-]?{D}{{3,4}}"
)
ORDER_NUMBER = rf"(?=#?{D}{{6}}){BOUNDARY}#?{D}{{6,}}-?{D}*{BOUNDARY}"
URL = rf"https?://{NOT_S}+"
HANDLE = rf"@{W}+"
CARET_TAG = rf"\^[A-Z]{{1,3}}{WORD_END}"
HASHTAG = rf"#{W}+"
DM_TAIL = rf"(?iu)dm(?<!{W}dm){WORD_END}[^\n]*{END}"
DIRECT_MESSAGE_TAIL = rf"{WORD_START}[dD]irect message{WORD_END}[^\n]*{END}"

STEP_TEMPLATE = (
    "Thanks for reaching out. Here's what I'll do:\n"
    "1) Check the latest scan and status.\n"
    "2) Confirm delivery address.\n"
    "3) Share an ETA or next step.\n\n"
)
HAS_STEPS = r"Here's what I'll do:|Here’s what I’ll do:"

ASCII_ONE_TO_ONE = ("\u2013\u2014\u2212\u2019\u2018\u201c\u201d\u00a0", "---''\"\" ")
ASCII_EXPANSIONS = (("→", "->"), ("←", "<-"), ("…", "..."))
# ------------------------------------------------------------------------------------------------


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # Not Arrow's own utf8_normalize, whose NFKC leaves characters decomposed.
    return pa.array([t and unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _casefold(text: pa.Array) -> pa.Array:
    return pa.array([t and t.casefold() for t in text.to_pylist()], pa.string())


def _non_ascii(c: Column) -> Column:
    """The text where it holds a non-ASCII character, else null; so ASCII text skips Python."""
    return F.when(F.octet_length(c) != F.char_length(c), c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, run_but_one_space(S), " "))


def nfkc(c: Column) -> Column:
    return F.coalesce(_nfkc(_non_ascii(c)), c)


def casefold(c: Column) -> Column:
    return F.coalesce(_casefold(_non_ascii(c)), F.lower(c))


def normalize_text(c: Column) -> Column:
    """NFKC, whitespace runs to one space, trimmed; null becomes the empty string."""
    return F.coalesce(collapse(nfkc(c)), F.lit(""))


def _where(c: Column, holds: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` the texts for which a cheap test holds; the others would stay as they are."""
    return let(c, lambda t: F.when(holds(t), change(t)).otherwise(t))


def _drop(c: Column, mark: str, pattern: str) -> Column:
    """Drop what matches a pattern that needs ``mark``."""
    return _where(c, lambda t: t.contains(mark), lambda t: F.regexp_replace(t, pattern, ""))


def redact_emails(c: Column) -> Column:
    return _where(
        c, lambda t: t.contains("@"), lambda t: F.regexp_replace(t, EMAIL, quote_replacement(EMAIL_MARK))
    )


def redact_phones(c: Column) -> Column:
    return F.regexp_replace(c, PHONE, quote_replacement(PHONE_MARK))


def redact_order_numbers(c: Column) -> Column:
    return F.regexp_replace(c, ORDER_NUMBER, quote_replacement(ORDER_MARK))


def drop_links_and_tags(c: Column) -> Column:
    for mark, pattern in (("http", URL), ("@", HANDLE), ("^", CARET_TAG)):
        c = _drop(c, mark, pattern)
    return c


def scrub_pii(c: Column) -> Column:
    numbers = _where(
        redact_emails(c), lambda t: t.rlike(D), lambda t: redact_order_numbers(redact_phones(t))
    )
    return drop_links_and_tags(numbers)


def alias_carriers(c: Column, names: list[str], alias: str) -> Column:
    """Replace carrier names by one alias, whole words in any case, in list order.

    Names that share no word can never compete for the same text, so they go in one pass.  So do long lists, unless
    the alias could be part of a name.
    """
    if len(names) > MANY and not {w for n in names for w in folded(n).split()} & set(folded(alias).split()):
        return F.regexp_replace(replace_words(c, names, alias), r"(?iu)shipping_a", "Shipping_A")
    words = [w for n in names for w in n.lower().split()]
    clash = len(set(words)) != len(words) or set(words) & set(alias.lower().split())
    groups = [[n] for n in names] if clash else [names] if names else []
    for group in groups:
        pattern = starts_with_any(group) + word("|".join(map(quote, group)))
        c = F.regexp_replace(c, pattern, quote_replacement(alias))
    return F.regexp_replace(c, r"(?iu)shipping_a", "Shipping_A")


def prepend_steps(c: Column) -> Column:
    """Put the step template in front, unless the text already announces its steps."""
    return F.regexp_replace(c, rf"(?s)\A(?!.*(?:{HAS_STEPS}))", quote_replacement(STEP_TEMPLATE))


def detwitterize_agent(c: Column, with_steps: bool) -> Column:
    c = drop_links_and_tags(c)
    c = F.regexp_replace(_drop(c, "#", HASHTAG), DM_TAIL, "")
    c = _drop(c, "irect message", DIRECT_MESSAGE_TAIL)
    c = F.replace(F.replace(collapse(c), F.lit("pls"), F.lit("please")), F.lit("thx"), F.lit("thanks"))
    return strip(prepend_steps(c) if with_steps else c)


def enforce_max_tokens(c: Column, max_tokens: int = 1024) -> Column:
    """Cut at four characters per token."""
    return F.substring(c, 1, 4 * max_tokens)


def dedup_key(c: Column) -> Column:
    """Casefolded words separated by single spaces."""
    return F.trim(F.regexp_replace(casefold(c), run_but_one_space(NOT_W), " "))


def ascii_safe(c: Column) -> Column:
    """Typographic dashes, quotes, arrows, ellipsis and NBSP to ASCII."""
    c = F.translate(c, *ASCII_ONE_TO_ONE)
    for char, plain in ASCII_EXPANSIONS:
        c = F.replace(c, F.lit(char), F.lit(plain))
    return c


def contains_any(c: Column, keywords: list[str]) -> Column:
    """True if the lower-cased text holds any lower-cased keyword as a substring."""
    if not keywords:
        return F.lit(False)
    if len(keywords) > MANY:
        return holds_any(F.lower(c), [k.lower() for k in keywords])
    options = "|".join(quote(k.lower()) for k in keywords)
    return F.coalesce(F.lower(c).rlike(options), F.lit(False))

"""Tracking-ID and carrier extraction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import let
from .patterns import D, S, WORD_END, WORD_START, WS, quote, word

# --- fixed values -------------------------------------------------------------------------------
CARRIER_ALIASES = [
    ("Shipping_A", "Shipping_A"), ("Shipping_B", "Shipping_B"), ("Shipping_C", "Shipping_C"),
    ("ShippingA", "Shipping_A"), ("ShippingB", "Shipping_B"), ("ShippingC", "Shipping_C"),
]
# A block is a run of letters and digits that holds a digit; neighbours join over "-" or space.
# Only the end of a run can be followed by a separator or a boundary, hence the atomic group.
# Under ignore-case Python's [A-Z] also takes the dotted capital I, Java's does not.
_CHAR = r"[A-Z0-9\x{130}]"
_BLOCK = rf"(?>{_CHAR}*{D}{_CHAR}*)"
ID_CANDIDATE = rf"(?iu){WORD_START}({_BLOCK}(?:[-{WS}]{_BLOCK}){{0,8}}){WORD_END}"
DATE_LIKE = rf"{WORD_START}{D}{{4}}-{D}{{1,2}}-{D}{{1,2}}{WORD_END}"
REFERENCE_LIKE = word(rf"(?:INV|ORDER|PO|REF)[-:{WS}]?{D}{{3,}}")
MIN_ID, MAX_ID = 8, 22
NO_MATCH_NOTE = "no obvious carrier/ids found"
# ------------------------------------------------------------------------------------------------


def id_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ID_CANDIDATE), F.lit(1))


def normalize_id(token: Column) -> Column:
    return F.upper(F.regexp_replace(token, rf"[-{WS}]", ""))


def _looks_like_id(token: Column) -> Column:
    length = F.char_length(F.regexp_replace(token, rf"[-{WS}]", ""))
    return length.between(MIN_ID, MAX_ID) & ~token.rlike(DATE_LIKE) & ~token.rlike(REFERENCE_LIKE)


def carrier_alias(text: Column, aliases: list[tuple[str, str]] = CARRIER_ALIASES) -> Column:
    """Carrier of the first alias, in list order, that the text holds as a word."""
    first = F.coalesce(
        *[F.when(text.rlike(word(quote(alias))), F.lit(carrier)) for alias, carrier in aliases]
    )
    # Most texts hold none, which one pass tells.
    any_alias = "|".join(quote(alias) for alias, _ in aliases)
    return F.when(text.rlike(f"(?iu)(?:{any_alias})"), first)


def tracking_ids(text: Column) -> Column:
    """Array of (id, raw), distinct by id, in message order; the first raw form is kept."""
    def first_raw(pair: Column) -> Column:
        return F.transform(
            F.array_distinct(pair["ids"]),
            lambda i: F.struct(
                i.alias("id"),
                F.get(pair["raw"], F.array_position(pair["ids"], i).cast("int") - 1).alias("raw"),
            ),
        )

    def with_ids(tokens: Column) -> Column:
        return F.struct(tokens.alias("raw"), F.transform(tokens, normalize_id).alias("ids"))

    return let(let(F.filter(id_candidates(text), _looks_like_id), with_ids), first_raw)


def parse_tracking(text: Column) -> Column:
    """struct<carrier, ids, ids_raw, notes>.  Blank and null text give no carrier and no ids."""
    def shape(found: Column) -> Column:
        carrier, ids = found["carrier"], found["ids"]
        return F.struct(
            carrier.alias("carrier"),
            ids["id"].alias("ids"),
            ids["raw"].alias("ids_raw"),
            F.when(carrier.isNull() & (F.size(ids) == 0), F.lit(NO_MATCH_NOTE)).alias("notes"),
        )

    safe = F.coalesce(text, F.lit(""))
    return let(
        F.struct(carrier_alias(safe).alias("carrier"), tracking_ids(safe).alias("ids")), shape
    )

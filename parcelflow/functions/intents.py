"""Message intent, missing-ID and routing rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import let
from .patterns import D, S, WORD_END, WORD_START, word
from .text import strip

# --- fixed values -------------------------------------------------------------------------------
LINK = word(rf"link|url|website|web{S}*site")
TRACKING = word(
    rf"track(?:ing)?|status|where{S}+(?:is|’s|'s)|locate|find|scans?"
    rf"|last{S}+(?:two|2){S}+scans?|update|trace|follow{S}*up"
)
DELIVERY_ISSUE = word(
    rf"delivered|not{S}+received|missing|lost|stolen|proof{S}+of{S}+delivery|pod"
    rf"|misdeliver(?:ed)?|left{S}+at"
)
ADDRESS = word(rf"address|postcode|zip|postal{S}+code|suite|apt|apartment|unit")
CUSTOMS = word(
    rf"customs|duty|tariff|hs{S}*code|clearance|invoice|id|proof{S}+of{S}+payment|declaration"
)
INTENT_RULES = [
    ("link_request", LINK),
    ("tracking", TRACKING),
    ("delivery_issue", DELIVERY_ISSUE),
    ("address", ADDRESS),
    ("customs", CUSTOMS),
]
DEFAULT_INTENT = "general"
INTENTS_NEEDING_ID = ["tracking", "link_request", "delivery_issue", "address"]

LABELLED_ID = (
    rf"(?iu){WORD_START}(?:awb|waybill|tracking|order){S}*(?:no\.?|number|id)?"
    rf"{S}*[:#-]?{S}*[A-Z0-9\x{{130}}\-]{{8,}}"
)
LONG_NUMBER = rf"{WORD_START}{D}{{8,}}{WORD_END}"
EVAL_ID = rf"(?:awb|waybill|tracking|order){S}*(?:no|number|id)|{LONG_NUMBER}"
MIN_PROVIDED_ID = 8

QUOTE_WORDS = ["quote", "rate", "price", "how much", "shipping cost", "label price"]
TRACKING_WORDS = ["track", "tracking", "scan", "status"]
ETA_WORDS = ["eta", "how long", "when arrive", "delivery time"]

SERVICE_WORDS = ["express", "standard", "economy"]
DEFAULT_SERVICE = "standard"
DEFAULT_ORIGIN = "JO"
COUNTRY_WORD = rf"{WORD_START}([A-Z]{{2}}){WORD_END}"
STRICT_LANE = rf"(?iu){WORD_START}([a-z]{{2}}){S}+to{S}+([a-z]{{2}}){WORD_END}"
# ------------------------------------------------------------------------------------------------


def _any_word(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def infer_intent(text: Column) -> Column:
    """First rule that matches the lower-cased text, in rule order."""
    def first_rule(low: Column) -> Column:
        return F.coalesce(
            *[F.when(low.rlike(pattern), F.lit(name)) for name, pattern in INTENT_RULES],
            F.lit(DEFAULT_INTENT),
        )

    return let(F.lower(text), first_rule)


def has_any_id(text: Column, provided: Column) -> Column:
    """An ID was given with the message, or the text holds a labelled or a long bare one."""
    return (
        F.coalesce(F.char_length(strip(provided)) >= MIN_PROVIDED_ID, F.lit(False))
        | text.rlike(LABELLED_ID)
        | text.rlike(LONG_NUMBER)
    )


def missing_id(text: Column, provided: Column, intent: Column | None = None) -> Column:
    intent = infer_intent(text) if intent is None else intent
    return intent.isin(INTENTS_NEEDING_ID) & ~has_any_id(text, provided)


def missing_id_any_intent(text: Column) -> Column:
    """The evaluation-set variant: no intents, and a label word is enough."""
    return ~F.lower(text).rlike(EVAL_ID)


def wants_link(text: Column) -> Column:
    return text.rlike(LINK)


def needs(text: Column, has_ids: Column) -> Column:
    """Multi-label routing: quote, retrieval, tracking_id, eta in that order."""
    def labels(low: Column) -> Column:
        tracking = _any_word(low, TRACKING_WORDS)
        return F.array_compact(
            F.array(
                F.when(_any_word(low, QUOTE_WORDS), F.lit("quote")),
                F.when(tracking, F.lit("retrieval")),
                F.when(tracking & ~has_ids, F.lit("tracking_id")),
                F.when(_any_word(low, ETA_WORDS), F.lit("eta")),
            )
        )

    return let(F.lower(text), labels)


def lane(text: Column, strict: bool = False) -> Column:
    """struct<origin_cc, dest_cc>.

    Default rule: the first two two-letter words of the upper-cased text.  Strict rule: only
    ``XX to YY``.  Origin falls back to the default country, destination to the origin.
    """
    if strict:
        codes = F.transform(
            F.array(F.regexp_extract(text, STRICT_LANE, 1), F.regexp_extract(text, STRICT_LANE, 2)),
            lambda c: F.nullif(F.upper(c), F.lit("")),
        )
    else:
        codes = F.regexp_extract_all(F.upper(text), F.lit(COUNTRY_WORD), F.lit(1))

    def fill(cc: Column) -> Column:
        origin = F.coalesce(F.get(cc, F.lit(0)), F.lit(DEFAULT_ORIGIN))
        return F.struct(
            origin.alias("origin_cc"), F.coalesce(F.get(cc, F.lit(1)), origin).alias("dest_cc")
        )

    return let(codes, fill)


def service_word(text: Column) -> Column:
    """First of express, standard, economy found as a substring; default standard."""
    def pick(low: Column) -> Column:
        return F.coalesce(
            *[F.when(low.contains(w), F.lit(w)) for w in SERVICE_WORDS], F.lit(DEFAULT_SERVICE)
        )

    return let(F.lower(text), pick)

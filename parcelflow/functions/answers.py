"""Contexts, model-free replies and answer composition for messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import non_empty
from .text import ascii_safe, strip

# --- fixed values -------------------------------------------------------------------------------
ASK_ID = "Please share a valid tracking ID (and carrier if known)."
ASK_ID_PLAIN = "Please share your tracking/waybill ID (and carrier if known)."
DISCLAIMER = "No live tracking is used; info is handbook-based."
ESTIMATE_NOTE = "- Note: This is a non-binding estimate; surcharges and contracts vary."
HISTORY_HEADING = "Previous turns:\n"
MAX_CONTEXTS = 4
# ------------------------------------------------------------------------------------------------

NO_TEXTS = "array<string>"


def _bulleted(*lines: Column) -> Column:
    present = F.array_compact(F.array(*lines))
    return F.array_join(F.transform(present, lambda b: F.concat(F.lit("- "), b)), "\n")


def offline_reply(contexts: Column, ids: Column, carrier: Column, provided: Column) -> Column:
    """Model-free reply of the message job; ``provided`` is used if the text has no ID."""
    first = F.coalesce(F.get(ids, F.lit(0)), non_empty(provided))
    parsed = F.concat(
        F.lit("Parsed tracking ID: "), first,
        F.lit(" (carrier: "), F.coalesce(carrier, F.lit("unknown")), F.lit(")."),
    )
    n = F.size(contexts)
    return _bulleted(
        F.coalesce(parsed, F.lit(ASK_ID)),
        F.when(n > 0, F.format_string("Using %d retrieved context chunk(s).", n)),
        F.lit(DISCLAIMER),
    )


def plain_reply(ids: Column, n_hits: Column) -> Column:
    """Model-free reply of the plain retrieval path."""
    return _bulleted(
        F.when(F.size(ids) == 0, F.lit(ASK_ID_PLAIN)),
        F.when(
            n_hits > 0, F.format_string("Using %d handbook chunk(s) from the knowledge base.", n_hits)
        ),
        F.lit(DISCLAIMER),
    )


def eta_note(eta: Column) -> Column:
    """Context sentence for an ETA struct; null if there is none."""
    return F.when(
        eta.isNotNull(),
        F.format_string(
            "ETA handbook estimate: %d–%d business days for %s from %s to %s. "
            "Clarify that this is not live tracking.",
            eta["min_days"], eta["max_days"], eta["service"], eta["origin_cc"], eta["dest_cc"],
        ),
    )


def gather_contexts(hit_texts: Column, note: Column, history: Column) -> Column:
    """History first, then non-empty hit texts, then the ETA note; the first four are kept."""
    previous = F.when(
        F.size(history) > 0, F.concat(F.lit(HISTORY_HEADING), F.array_join(history, "\n"))
    )
    kept = F.filter(F.coalesce(hit_texts, F.array().cast(NO_TEXTS)), lambda t: F.char_length(t) > 0)
    full = F.concat(F.array_compact(F.array(previous)), kept, F.array_compact(F.array(note)))
    return F.slice(full, 1, MAX_CONTEXTS)


def number_text(c: Column) -> Column:
    """Two-decimal amount with trailing zeros dropped down to one decimal, as in ``8.0``."""
    return F.regexp_replace(c.cast("decimal(20,2)").cast("string"), r"(\.\d)0$", "$1")


def answer_parts(ids: Column, carrier: Column, eta: Column, quote: Column) -> Column:
    """Array of the structured bullets: parsed ID, ETA, and two price lines."""
    id_line = F.concat(
        F.lit("- Parsed tracking ID: "), F.get(ids, F.lit(0)),
        F.lit(" (carrier: "), F.coalesce(carrier, F.lit("unknown")), F.lit(")."),
    )
    eta_line = F.when(
        eta.isNotNull(),
        F.format_string(
            "- ETA (handbook): %d–%d business days (%s, %s→%s).",
            eta["min_days"], eta["max_days"], eta["service"], eta["origin_cc"], eta["dest_cc"],
        ),
    )
    price_line = F.when(
        quote.isNotNull(),
        F.format_string(
            "- Estimated label price: ~$%s USD (%s, zone: %s, billable %s kg).",
            number_text(quote["price_usd"]), quote["service"], quote["zone"],
            number_text(quote["billable_kg"]),
        ),
    )
    note_line = F.when(quote.isNotNull(), F.lit(ESTIMATE_NOTE))
    return F.array_compact(F.array(id_line, eta_line, price_line, note_line))


def compose_answer(parts: Column, reply: Column) -> Column:
    """Structured bullets, then the reply; typographic characters made ASCII."""
    body = F.array_compact(F.array(non_empty(ascii_safe(strip(reply)))))
    return ascii_safe(F.array_join(F.concat(parts, body), "\n"))

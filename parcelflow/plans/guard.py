"""The answer-guard job: clean raw answers and count what passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import guard as G, intents as I


def guard_answers(raw_answers: DataFrame, any_intent: bool = False) -> DataFrame:
    """Add intent, require_id, refuse_link and the guarded answer to RAW_ANSWERS rows.

    ``any_intent`` uses the evaluation-set rule for a missing ID.
    """
    message, tracking = F.col("user_msg"), F.col("tracking")
    missing = (
        I.missing_id_any_intent(message) if any_intent else I.missing_id(message, tracking, F.col("intent"))
    )
    return (
        raw_answers.withColumn("intent", I.infer_intent(message))
        .withColumn("require_id", missing)
        .withColumn("refuse_link", I.wants_link(message))
        .withColumn(
            "answer", G.guard_answer(F.col("raw"), F.col("require_id"), F.col("refuse_link"))
        )
    )


def audit(guarded: DataFrame) -> DataFrame:
    """Add the pass flags and the blocked substrings that are left."""
    answer = F.col("answer")
    return (
        guarded.withColumn("asks_id", G.asks_for_ids(answer))
        .withColumn("no_links", ~G.contains_linkish(answer))
        .withColumn("concise", G.is_concise_bullets(answer))
        .withColumn("blocked", G.blocked_patterns(answer))
    )


def guard_report(guarded: DataFrame) -> DataFrame:
    """Pass counters per intent."""
    return audit(guarded).groupBy("intent").agg(
        F.count("*").alias("answers"),
        F.count_if("asks_id").alias("ask_ids"),
        F.count_if("no_links").alias("no_links"),
        F.count_if("concise").alias("concise"),
        F.count_if(F.size("blocked") > 0).alias("blocked"),
    )

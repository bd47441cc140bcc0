"""The message job: parse, route, estimate, retrieve, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import answers as A, citations as C, guard as G, intents as I
from ..functions.columns import let, non_empty
from ..functions.tracking import parse_tracking
from ..operators import lanes as L
from ..operators.history import HISTORY_SIZE, conversation_spans, entry_line, recall, with_first
from ..operators.similarity import HIT_LIST as HITS, TASKS_PER_CORE, collect_hits, dealt, small_chunk_hits, topk
from ..operators.vector_index import VectorIndex, search_index
from ..staging import stage
from ..streaming.memory import GenerateText, GenerateTexts, many_of, answer_in_waves, memory_after

# text -> vector, a vectorised UDF; it gets null for messages that do not search
Embed = Callable[[Column], Column]
# (user text, contexts, tracking id) -> reply
Generate = Callable[[Column, Column, Column], Column]

# --- fixed values -------------------------------------------------------------------------------
# What a quote is based on where the message row does not say.
QUOTE_DEFAULTS = {
    "origin_cc": "JO", "dest_cc": "AE", "service": "standard", "weight_kg": 1.0,
    "l_cm": None, "w_cm": None, "h_cm": None,
}
RETRIEVED = 4
# ------------------------------------------------------------------------------------------------


def understand(messages: DataFrame) -> DataFrame:
    """Add carrier, ids, ids_raw, notes, intent, needs, missing_id and wants_link.

    A carrier or tracking ID given with the message comes before what the text holds.
    """
    given = F.array_compact(F.array(non_empty(F.col("tracking"))))
    return (
        messages.withColumn("parsed", parse_tracking(F.col("text")))
        .withColumn("carrier", F.coalesce(non_empty(F.col("carrier")), F.col("parsed.carrier")))
        .withColumn("ids", F.array_distinct(F.concat(given, F.col("parsed.ids"))))
        .withColumn("ids_raw", F.col("parsed.ids_raw"))
        .withColumn("notes", F.col("parsed.notes"))
        .drop("parsed")
        .withColumn("intent", I.infer_intent(F.col("text")))
        .withColumn("needs", I.needs(F.col("text"), F.size("ids") > 0))
        .withColumn("missing_id", I.missing_id(F.col("text"), F.col("tracking"), F.col("intent")))
        .withColumn("wants_link", I.wants_link(F.col("text")))
    )


def tracking_rows(messages: DataFrame) -> DataFrame:
    """One row per parsed ID: msg_id, pos, id, raw, carrier."""
    return messages.select(
        "msg_id", parse_tracking(F.col("text")).alias("parsed")
    ).select(
        "msg_id", "parsed.carrier",
        F.posexplode(F.arrays_zip(F.col("parsed.ids").alias("id"), F.col("parsed.ids_raw").alias("raw"))),
    ).select("msg_id", "pos", "col.id", "col.raw", "carrier")


def ids_per_carrier(messages: DataFrame) -> DataFrame:
    parsed = messages.select(parse_tracking(F.col("text")).alias("p"))
    return (
        parsed.select(F.coalesce("p.carrier", F.lit("unknown")).alias("carrier"), F.size("p.ids").alias("n"))
        .groupBy("carrier")
        .agg(F.count("*").alias("messages"), F.sum("n").alias("ids"))
    )


def intent_counts(messages: DataFrame) -> DataFrame:
    return (
        messages.select(
            I.infer_intent(F.col("text")).alias("intent"), F.col("text"), F.col("tracking")
        )
        .withColumn("missing", I.missing_id(F.col("text"), F.col("tracking"), F.col("intent")))
        .groupBy("intent")
        .agg(
            F.count("*").alias("messages"),
            F.count_if("missing").alias("missing_id"),
            F.count_if(I.wants_link(F.col("text"))).alias("wants_link"),
        )
    )


def with_estimates(messages: DataFrame) -> DataFrame:
    """Add the ``eta`` and ``quote`` structs to understood messages that need them.

    The ETA's lane and service come from the text; the quote's from columns of those names, where
    the rows have them, else from the defaults.
    """
    lane = I.lane(F.col("text"))
    columns = set(messages.columns)

    def given(name: str) -> Column:
        default = QUOTE_DEFAULTS[name]
        fallback = F.lit(default).cast("string" if isinstance(default, str) else "double")
        return F.coalesce(F.col(name), fallback) if name in columns else fallback

    def eta(asked: Column) -> Column:
        origin, dest, service = asked["lane"]["origin_cc"], asked["lane"]["dest_cc"], asked["service"]
        low, high = L.eta_days(L.zone(origin, dest), service)
        return F.struct(
            origin.alias("origin_cc"), dest.alias("dest_cc"), service.alias("service"),
            low.alias("min_days"), high.alias("max_days"),
        )

    asked = F.struct(lane.alias("lane"), I.service_word(F.col("text")).alias("service"))
    quoted = (
        messages.withColumn(
            "eta", F.when(F.array_contains("needs", "eta"), let(asked, eta))
        )
        .withColumn("_service", L.service_name(given("service")))
        .withColumn("_zone", L.zone(L.country(given("origin_cc")), L.country(given("dest_cc"))))
        .withColumn(
            "_kg", L.billable_kg(given("weight_kg"), given("l_cm"), given("w_cm"), given("h_cm"))
        )
    )
    quote = F.struct(
        F.col("_service").alias("service"), F.col("_zone").alias("zone"), F.col("_billable").alias("billable_kg"),
        L.price_usd(F.col("_zone"), F.col("_service"), F.col("_kg")).alias("price_usd"),
    )
    return (
        L.with_cents(quoted, "_kg", "_billable")
        .withColumn("quote", F.when(F.array_contains("needs", "quote"), quote))
        .drop("_service", "_zone", "_kg", "_billable")
    )


def with_vectors(messages: DataFrame, embed: Embed | None) -> DataFrame:
    """Add ``vec`` to understood messages; only texts that need retrieval are embedded."""
    if embed is None:
        return messages
    asked = F.when(F.array_contains("needs", "retrieval"), F.col("text"))
    return messages.withColumn("vec", embed(asked))


def to_search(messages: DataFrame, chunks: DataFrame | None, embed: Embed | None = None) -> DataFrame:
    """Understood messages for ``with_hits``.  Those that search cost far more than their bytes tell, so they are dealt
    over more tasks than there are cores."""
    searching = chunks is not None and (embed is not None or "vec" in messages.columns)
    return with_estimates(understand(dealt(messages) if searching else messages))


def with_hits(
    messages: DataFrame,
    chunks: DataFrame | None,
    k: int = RETRIEVED,
    embed: Embed | None = None,
    max_held: int | None = None,
    index: VectorIndex | None = None,
) -> DataFrame:
    """Add ``hits`` to understood messages with a ``vec`` (or an ``embed`` that makes one); only
    those that need retrieval search.  ``max_held`` replaces the number of vectors that tasks may hold.
    With ``index``, an index of ``chunks``, a search that tasks cannot hold reads the nearest cells only."""
    messages = with_vectors(messages, embed)
    none = F.array().cast(HITS)
    if chunks is None or "vec" not in messages.columns:
        return messages.withColumn("hits", none)
    limit = {} if max_held is None else {"max_broadcast": max_held}
    find = small_chunk_hits(chunks, k, **limit)
    if find is not None:
        wanted = F.when(F.array_contains("needs", "retrieval"), F.col("vec"))
        return messages.withColumn("hits", find(wanted, F.col("carrier")))
    # Read by several jobs: written, so that messages are understood and embedded once.
    messages = stage(messages, "understood")
    asking = messages.filter(F.array_contains("needs", "retrieval")).select(
        F.col("msg_id").alias("query_id"), "vec", "carrier"
    )
    best = topk(asking, chunks, k, **limit) if index is None else search_index(asking, index, k, **limit)
    hits = collect_hits(best, chunks).withColumnRenamed("query_id", "msg_id")
    return messages.join(hits, "msg_id", "left").withColumn("hits", F.coalesce("hits", none))


def _default_generate(ids: Column, carrier: Column, tracking: Column) -> Generate:
    return lambda text, contexts, tracking_id: A.offline_reply(contexts, ids, carrier, tracking)


def respond(
    messages: DataFrame, generate: Generate | None = None, guarded: bool = False
) -> DataFrame:
    """Add contexts, reply, answer and citations; needs history (or it counts as empty).

    ``guarded`` cleans the generator's reply into safe bullets, asks for a missing ID and refuses links.
    """
    history = F.col("history") if "history" in messages.columns else F.array().cast("array<string>")
    make = generate or _default_generate(F.col("ids"), F.col("carrier"), F.col("tracking"))
    reply = make(F.col("text"), F.col("contexts"), F.get("ids", F.lit(0)))
    if generate and guarded:
        reply = G.guard_answer(reply, F.col("missing_id"), F.col("wants_link"))
    return (
        messages.withColumn(
            "contexts", A.gather_contexts(F.col("hits.text"), A.eta_note(F.col("eta")), history)
        )
        .withColumn("reply", reply)
        .withColumn(
            "parts", A.answer_parts(F.col("ids"), F.col("carrier"), F.col("eta"), F.col("quote"))
        )
        .withColumn("answer", A.compose_answer(F.col("parts"), F.col("reply")))
        .withColumn(
            "citations", C.reply_citations(C.citation_list(F.col("hits")), F.col("hits"))
        )
    )


def answer_messages(
    messages: DataFrame,
    chunks: DataFrame | None = None,
    generate: Generate | None = None,
    k: int = RETRIEVED,
    embed: Embed | None = None,
    guarded: bool = False,
    max_held: int | None = None,
    index: VectorIndex | None = None,
) -> DataFrame:
    """MESSAGES rows (optionally with vec, history, quote columns) to answers with citations."""
    ready = with_hits(to_search(messages, chunks, embed), chunks, k, embed, max_held, index)
    return respond(ready, generate, guarded)


def both_answers(ready: DataFrame) -> DataFrame:
    """Add answer_first and answer_later: the answer without and with a history before it.

    The model-free reply hangs on whether there is a history, not on its wording.
    """
    none, some = F.array().cast(A.NO_TEXTS), F.array(F.lit("earlier"))
    later = respond(ready.withColumn("history", some)).withColumnRenamed("answer", "answer_later")
    return respond(later.withColumn("history", none)).withColumnRenamed("answer", "answer_first")


def ready_messages(
    messages: DataFrame,
    chunks: DataFrame | None = None,
    k: int = RETRIEVED,
    embed: Embed | None = None,
) -> DataFrame:
    """Everything about a message that does not depend on its conversation's past.

    Rows that have ``hits`` already keep them.
    """
    known = messages if "hits" in messages.columns else with_hits(to_search(messages, chunks, embed), chunks, k, embed)
    clear = F.coalesce("clear", F.lit(False)) if "clear" in messages.columns else F.lit(False)
    return both_answers(known).withColumn("tracking_id", F.get("ids", F.lit(0))).withColumn("clear", clear)


def converse(
    messages: DataFrame,
    chunks: DataFrame | None = None,
    embed: Embed | None = None,
    generate: GenerateText | None = None,
    guarded: bool = False,
    generate_many: GenerateTexts | None = None,
    memory: DataFrame | None = None,
) -> DataFrame:
    """Answer whole conversations with memory: batch form of the streaming job.

    One shuffle by conversation serves both steps, which row is the first and what came before.  With a
    generator, whose replies become part of the memory, or with a ``memory`` (conv_id, lines) to begin with,
    conversations advance in waves: the next message of many of them at once, which ``generate_many`` answers in one
    call.  With ``clear`` flags alone, a message that empties the memory begins its conversation anew.
    """
    make = many_of(generate, generate_many)
    if make is not None or memory is not None or "clear" in messages.columns:
        if make is None and memory is None and "hits" not in messages.columns:
            return _converse_cleared(messages, chunks, embed)
        ready = ready_messages(messages, chunks, embed=embed)
        return answer_in_waves(ready, make, guarded, memory, with_lines=False)
    spans = conversation_spans(messages)
    ready = both_answers(with_hits(to_search(messages, chunks, embed), chunks, embed=embed)).select(
        "msg_id", "conv_id", "turn", "text", "answer_first", "answer_later", "citations"
    )
    if spans is not None:
        ready = stage(ready, "ready")  # read once more for what the spans hand over
    answered = with_first(ready, spans).withColumn(
        "answer", F.when(F.col("first"), F.col("answer_first")).otherwise(F.col("answer_later"))
    )
    lines = F.array(
        entry_line(F.lit("user"), F.col("text")), entry_line(F.lit("assistant"), F.col("answer"))
    )
    return recall(answered.withColumn("lines", lines), spans, per_row=2).select(
        "msg_id", "conv_id", "turn", "answer", "citations", "history"
    )


def _converse_cleared(messages: DataFrame, chunks: DataFrame | None, embed: Embed | None) -> DataFrame:
    """``converse`` where a message with ``clear`` empties the memory first.

    Whether there is a history is known before the text is understood, so one answer is made, and one shuffle of the
    messages serves the numbering and what came before.  Messages without a conversation have no memory.
    """
    lone = F.col("conv_id").isNull()
    order = ["turn", "msg_id"]
    # As many partitions as a scan of costly rows, which the bytes of a message do not tell.
    tasks = max(
        TASKS_PER_CORE * messages.sparkSession.sparkContext.defaultParallelism,
        int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    rows = messages.withColumns(
        {"clear": F.coalesce("clear", F.lit(False)), "_lone": F.when(lone, F.xxhash64(*order))}
    ).repartition(tasks, "conv_id", "_lone")
    own = Window.partitionBy("conv_id", "_lone").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "_part": F.count_if("clear").over(so_far),
            "_first": lone | F.col("clear") | (F.row_number().over(own) == 1),
        }
    )
    some = F.when(~F.col("_first"), F.array(F.lit("earlier")))
    known = with_hits(to_search(rows, chunks, embed), chunks, embed=embed)
    known = known.withColumn("history", F.coalesce(some, F.array().cast(A.NO_TEXTS)))
    lines = F.array(entry_line(F.lit("user"), F.col("text")), entry_line(F.lit("assistant"), F.col("answer")))
    answered = respond(known).withColumn("_said", F.struct("_part", lines.alias("lines")))
    before = F.collect_list("_said").over(own.rowsBetween(-(HISTORY_SIZE // 2), -1))
    mine = F.filter("_before", lambda x: (x["_part"] == F.col("_part")) & ~lone)
    bigints = [F.col(c).cast("bigint").alias(c) for c in ("msg_id", "conv_id", "turn")]
    return answered.withColumn("_before", before).select(
        *bigints, "answer", "citations", F.flatten(F.transform(mine, lambda x: x["lines"])).alias("history")
    )


def memory_of(messages: DataFrame, answered: DataFrame) -> DataFrame:
    """(conv_id, lines): what each conversation remembers after its last answer, to begin a stream with."""
    said = messages.select("msg_id", entry_line(F.lit("user"), F.col("text")).alias("said"))
    reply = entry_line(F.lit("assistant"), F.col("answer"))
    lines = F.concat("history", F.array("said", reply))
    lines = F.slice(lines, F.greatest(F.size(lines) - (HISTORY_SIZE - 1), F.lit(1)), HISTORY_SIZE)
    return memory_after(answered.join(said, "msg_id").withColumn("lines", lines))


def plain_answers(messages: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """The plain retrieval path: every message searches, the reply counts its hits."""
    found = with_hits(
        dealt(messages).withColumn("carrier", F.lit(None).cast("string")).withColumn(
            "needs", F.array(F.lit("retrieval"))
        ),
        chunks, k,
    )
    label = F.transform("hits", lambda h: C.citation_label(h["source"], h["chunk_id"]))
    ids = parse_tracking(F.col("text"))["ids"]
    return found.withColumn("answer", A.plain_reply(ids, F.size("hits"))).withColumn(
        "citations", F.slice(label, 1, k)
    )

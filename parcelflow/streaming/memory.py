"""Bounded conversation memory: walked through in waves over a table, kept as state over a stream.

A wave is the next message of many conversations.  Their replies need only what was said before in each of
them, so a generator answers a whole wave in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.answers import HISTORY_HEADING, MAX_CONTEXTS
from ..functions.guard import guard_texts
from ..functions.text import ASCII_EXPANSIONS, ASCII_ONE_TO_ONE
from ..operators.history import HISTORY_SIZE, MAX_CONTENT, entry_line
from ..staging import stage

# (user text, contexts, tracking id) -> reply
GenerateText = Callable[[str, list[str], str | None], str]
# the same for a wave of messages: columns in, one reply for each row out
GenerateTexts = Callable[[pd.Series, pd.Series, pd.Series], pd.Series]

# What all need, and what ready-made answers, a generator and its guard need on top.
COLUMNS = ["msg_id", "turn", "user_line", "citations", "clear"]
READY_COLUMNS = ["answer_first", "answer_later"]
GENERATOR_COLUMNS = ["text", "contexts", "parts", "tracking_id"]
GUARD_COLUMNS = ["missing_id", "wants_link"]
OUTPUT = "msg_id bigint, conv_id bigint, turn bigint, answer string, citations string, history array<string>"
MEMORY = "conv_id bigint, lines array<string>"
#: Conversations whose memory a task holds at a time.
WAVE = 10_000
#: Buckets of conversations in the state of a stream, fixed for its life, and that of messages without a conversation.
STATE_BUCKETS = 2048
NO_CONVERSATION = -1
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def one_by_one(generate: GenerateText) -> GenerateTexts:
    """A generator of single replies as one of waves."""

    def many(texts: pd.Series, contexts: pd.Series, tracking_ids: pd.Series) -> pd.Series:
        return pd.Series([generate(*row) for row in zip(texts, contexts, tracking_ids)], dtype=object)

    return many


def many_of(generate: GenerateText | None, generate_many: GenerateTexts | None) -> GenerateTexts | None:
    return generate_many or (one_by_one(generate) if generate else None)


ONE_TO_ONE = str.maketrans(*ASCII_ONE_TO_ONE)


def _ascii(text: str) -> str:
    if text.isascii():
        return text
    text = text.translate(ONE_TO_ONE)
    for char, plain in ASCII_EXPANSIONS:
        text = text.replace(char, plain)
    return text


def _replies(wave: dict[str, list], seen: list[list[str]], generate: GenerateTexts, guarded: bool) -> list[str]:
    """What the generator says to a wave, all in one call."""
    contexts = [
        (([HISTORY_HEADING + "\n".join(s)] if s else []) + list(own))[:MAX_CONTEXTS]
        for s, own in zip(seen, wave["contexts"])
    ]
    asked = (pd.Series(column, dtype=object) for column in (wave["text"], contexts, wave["tracking_id"]))
    said = pd.Series(list(generate(*asked)), dtype=object)
    if guarded:
        said = guard_texts(said, pd.Series(wave["missing_id"]), pd.Series(wave["wants_link"]))
    return [_ascii(reply.strip()) for reply in said]


def answer_wave(
    wave: dict[str, list], lines: list[list[str]], generate: GenerateTexts | None, guarded: bool
) -> tuple[list[str], list[list[str]], list[list[str]]]:
    """Answers to one message of each of several conversations, the history each saw, and the memory after it.

    ``wave`` holds the columns of the messages, ``lines`` the memory of each conversation before its message.
    """
    seen = [[] if clear else before for clear, before in zip(wave["clear"], lines)]
    if generate is None:
        both = zip(seen, wave["answer_first"], wave["answer_later"])
        answers = [later if s else first for s, first, later in both]
    else:
        replies = _replies(wave, seen, generate, guarded)
        bodies = (filter(None, (parts, reply)) for parts, reply in zip(wave["parts"], replies))
        answers = [_ascii("\n".join(body)) for body in bodies]
    after = [
        (s + [user, f"assistant: {answer[:MAX_CONTENT]}"])[-HISTORY_SIZE:]
        for s, user, answer in zip(seen, wave["user_line"], answers)
    ]
    return answers, seen, after


def _out(wave: dict[str, list], answers: list[str], seen: list[list[str]]) -> pd.DataFrame:
    kept = {c: wave[c] for c in ("msg_id", "conv_id", "turn")}
    return pd.DataFrame({**kept, "answer": answers, "citations": wave["citations"], "history": seen})


def _plain(wave: dict[str, list]) -> dict[str, list]:
    """Missing tracking ids as None, whatever the frame made of them."""
    if "tracking_id" in wave:
        wave["tracking_id"] = [i if isinstance(i, str) else None for i in wave["tracking_id"]]
    return wave


def _columns(generate: GenerateTexts | None, guarded: bool) -> list[str]:
    """What a wave reads, and nothing else, as the rest would be made of each text and handed over for nothing."""
    if generate is None:
        return COLUMNS + READY_COLUMNS
    return COLUMNS + GENERATOR_COLUMNS + (GUARD_COLUMNS if guarded else [])


def _prepared(ready: DataFrame) -> DataFrame:
    # Citations and parts pass through as text, which costs less to hand over than nested values.
    return ready.withColumns(
        {
            "user_line": entry_line(F.lit("user"), F.col("text")),
            "parts": F.array_join("parts", "\n"),
            "citations": F.to_json("citations"),
        }
    )


def answer_in_waves(
    ready: DataFrame,
    generate: GenerateTexts | None = None,
    guarded: bool = False,
    memory: DataFrame | None = None,
    wave: int = WAVE,
    with_lines: bool = True,
) -> DataFrame:
    """``answer_with_memory`` over a whole table: message by message, all conversations of a bucket at once.

    Conversations are dealt into buckets of about ``wave``.  A task sorts its buckets by the number of the message
    in its conversation, so what it reads is one wave after the other, and holds the memories of one bucket.
    A long conversation takes time, as each reply needs the one before, but no room.  Messages without a
    conversation have no memory.  ``memory`` (conv_id, lines) is what conversations begin with.
    Adds ``lines``, the memory after the message, unless ``with_lines`` is off.
    """
    columns = _columns(generate, guarded)
    tasks = int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Counted by sketch: a bucket may hold some more or some less.
    buckets = max(tasks, -(-ready.agg(F.approx_count_distinct("conv_id")).first()[0] // wave))
    rows = _prepared(ready).select("conv_id", *columns)
    if memory is not None:
        rows = rows.join(memory.select("conv_id", F.col("lines").alias("before")), "conv_id", "left")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets))).repartition("bucket")
    # Clustered by bucket already, so numbering and sorting move nothing.
    number = F.row_number().over(Window.partitionBy("bucket", "conv_id").orderBy("turn", "msg_id"))
    order = ["bucket", "wave", "conv_id"]
    waves = dealt.withColumn("wave", number).sortWithinPartitions(*order)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, memories = None, {}
        for part in parts:
            for (at, _), rows in part.groupby(["bucket", "wave"], sort=False):
                if at != bucket:
                    bucket, memories = at, {}
                wave_rows = {c: rows[c].tolist() for c in rows.columns}
                convs = [None if c != c else c for c in wave_rows["conv_id"]]
                held = wave_rows.get("before") or [None] * len(rows)
                first = [[] if b is None else list(b) for b in held]
                lines = [[] if c is None else memories.get(c, b) for c, b in zip(convs, first)]
                answers, seen, after = answer_wave(_plain(wave_rows), lines, generate, guarded)
                memories.update(zip(convs, after))
                out = _out(wave_rows, answers, seen)
                yield out.assign(lines=after) if with_lines else out

    answered = waves.mapInPandas(walk, f"{OUTPUT}, lines array<string>" if with_lines else OUTPUT)
    return answered.withColumn("citations", F.from_json("citations", "array<string>"))


def memory_after(answered: DataFrame) -> DataFrame:
    """(conv_id, lines): the memory of each conversation after its last message in ``answer_in_waves``."""
    last = F.max_by("lines", F.struct("turn", "msg_id")).alias("lines")
    return answered.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(last)


class ConversationMemory(StatefulProcessor):
    """The last entries of the conversations of a bucket as map state, one value for each of them.

    A micro-batch calls once for a bucket, whose conversations advance in waves, and reads and writes the values of
    those that speak alone.  With ``idle_ms`` a value lives that long after the last message; initial rows
    (conv_id, lines) are taken over from a batch.
    """

    def __init__(self, generate: GenerateTexts | None, guarded: bool, idle_ms: int | None):
        self.generate, self.guarded, self.idle_ms = generate, guarded, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "conv_id bigint", "lines array<string>", self.idle_ms)

    def _before(self, conv: int) -> list[str]:
        found = self.lines.getValue((conv,))
        return [] if found is None else list(found[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The messages of a bucket in one micro-batch, which the source bounds.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["turn", "msg_id"], kind="stable")
        number = batch.groupby("conv_id").cumcount().to_numpy()
        batch = batch.iloc[np.argsort(number, kind="stable")]
        columns = _plain({c: batch[c].tolist() for c in batch.columns})
        ends = np.cumsum(np.bincount(number)).tolist()
        memories = {conv: self._before(conv) for conv in columns["conv_id"][:ends[0]]}
        answers, histories = [], []
        for start, end in zip([0, *ends], ends):
            wave = {c: values[start:end] for c, values in columns.items()}
            said, seen, after = answer_wave(
                wave, [memories[conv] for conv in wave["conv_id"]], self.generate, self.guarded
            )
            memories.update(zip(wave["conv_id"], after))
            answers += said
            histories += seen
        for conv, lines in memories.items():
            self.lines.updateValue((conv,), (lines,))
        out = _out(columns, answers, histories)
        yield out.assign(conv_id=None) if key[0] == NO_CONVERSATION else out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for conv, lines in zip(initialState["conv_id"].tolist(), initialState["lines"]):
            self.lines.updateValue((conv,), (list(lines)[-HISTORY_SIZE:],))

    def close(self) -> None:
        pass


def _bucketed(rows: DataFrame) -> DataFrame:
    """Rows with their ``bucket``, which hangs on the conversation alone; those without one share a bucket."""
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(STATE_BUCKETS)).cast("int")
    return rows.withColumns(
        {
            "bucket": F.when(F.col("conv_id").isNull(), F.lit(NO_CONVERSATION)).otherwise(bucket),
            "conv_id": F.coalesce("conv_id", F.lit(0)),
        }
    )


def answer_with_memory(
    ready: DataFrame,
    generate: GenerateTexts | None = None,
    idle_ms: int | None = None,
    guarded: bool = False,
    memory: DataFrame | None = None,
) -> DataFrame:
    """Answers of a stream in turn order per conversation, each seeing the last entries before it.

    ``ready`` comes from ``ready_messages``.  The memory is read before a message and gets two
    entries after it.  A row with ``clear`` empties it first; with ``idle_ms`` it is also dropped
    after that much silence (for queries that keep running).  Without ``generate``, the ready-made answers are
    used, which differ only in whether there is a history.  ``guarded`` cleans what the generator says.
    ``memory`` (conv_id, lines) is what a batch before the stream hands over.

    The state is kept in RocksDB, which map state and time-to-live need; the session is set to it.  Its key is a
    bucket of conversations, as a call for each of them costs far more than its messages.
    """
    ready.sparkSession.conf.set(STATE_STORE, ROCKS)
    columns = _columns(generate, guarded)
    # Written, so that the first micro-batch reads it like any table.
    start = None
    if memory is not None:
        start = stage(_bucketed(memory.select("conv_id", "lines")), "memory").groupBy("bucket")
    return (
        _bucketed(_prepared(ready).select("conv_id", *columns)).groupBy("bucket")
        .transformWithStateInPandas(
            ConversationMemory(generate, guarded, idle_ms), OUTPUT, "Append",
            "ProcessingTime" if idle_ms else "None", start,
        )
        .withColumn("citations", F.from_json("citations", "array<string>"))
    )

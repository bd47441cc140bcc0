import random
import time
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from parcelflow.functions import answers as A
from parcelflow.functions.tracking import carrier_alias
from parcelflow.operators.history import conversation_spans, with_first, with_history
from parcelflow.plans import triage
from parcelflow.plans.guard import audit, guard_answers, guard_report
from parcelflow.schemas import MESSAGES, RAW_ANSWERS, TURNS
from parcelflow.sources.messages import read_messages, stream_answers, stream_messages, write_answers
from parcelflow.streaming import memory as M, pipeline as P
from parcelflow.streaming.pipeline import answer_stream, read_stream_answers, stream_pipeline


def turns():
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        numbers = sorted(rng.sample(range(0, 80), rng.randint(1, 12)))
        if conv == 0:
            numbers = list(range(0, 400))  # most of all rows
        rows += [(conv, t, rng.choice(["user", "assistant", "system"]), f"m{conv}.{t} " + "x" * 600 * (t % 2)) for t in numbers]
    return rows


@pytest.mark.parametrize("share, span_rows", [(0.001, 10**6), (0.3, 50), (0.0, 1), (0.0, 5)])
def test_history_is_the_last_six_entries(spark, share, span_rows):
    rows = turns()
    expected, firsts = {}, set()
    for conv in range(12):
        before = []
        for _, t, role, text in [r for r in rows if r[0] == conv]:
            firsts.add((conv, min(r[1] for r in rows if r[0] == conv)))
            if role != "system":
                expected[conv, t] = before[-6:]
                before.append(f"{role}: {text[:500]}")
    table = spark.createDataFrame(rows, TURNS)
    found = {(r["conv_id"], r["turn"]): r["history"] for r in with_history(table, share=share, span_rows=span_rows).collect()}
    assert found == expected
    spans = conversation_spans(table, share, span_rows)
    assert (spans is None) == (span_rows == 10**6)
    marked = with_first(table, spans).filter("first").select("conv_id", "turn").collect()
    assert {tuple(r) for r in marked} == firsts


MESSAGE_ROWS = [
    (1, 10, 1, "Track my order", None, None),
    (2, 10, 2, "When will it arrive JO to AE express? eta", None, None),
    (3, 10, 3, "How much to ship 1kg?", None, None),
    (4, 10, 4, "status of AB12CD34 with Shipping_B", None, None),
    (5, 20, 1, "Track my order", "TRK12345678", "Shipping_C"),
    (6, 20, 2, "thanks – bye", None, None),
]


def messages(spark):
    return spark.createDataFrame(MESSAGE_ROWS, MESSAGES)


def test_answers_in_batch(spark):
    out = {r["msg_id"]: r for r in triage.converse(messages(spark)).collect()}
    ask = "- Please share a valid tracking ID (and carrier if known)."
    end = "- No live tracking is used; info is handbook-based."
    used = "- Using {} retrieved context chunk(s)."
    assert out[1]["answer"] == f"{ask}\n{end}"
    # The first two two-letter words are the lane.
    assert out[2]["answer"] == (
        f"- ETA (handbook): 3-8 business days (express, IT->JO).\n{ask}\n{used.format(2)}\n{end}"
    )
    assert out[3]["answer"] == (
        "- Estimated label price: ~$8.0 USD (standard, zone: INTRA_REGION, billable 1.0 kg).\n"
        f"- Note: This is a non-binding estimate; surcharges and contracts vary.\n{ask}\n{used.format(1)}\n{end}"
    )
    line = "- Parsed tracking ID: AB12CD34 (carrier: Shipping_B)."
    assert out[4]["answer"] == f"{line}\n{line}\n{used.format(1)}\n{end}"
    given = "- Parsed tracking ID: TRK12345678 (carrier: Shipping_C)."
    assert out[5]["answer"] == f"{given}\n{given}\n{end}"
    assert out[4]["history"] == [
        "user: Track my order", f"assistant: {out[1]['answer']}",
        f"user: {MESSAGE_ROWS[1][3]}", f"assistant: {out[2]['answer']}",
        f"user: {MESSAGE_ROWS[2][3]}", f"assistant: {out[3]['answer']}",
    ]
    assert out[1]["history"] == [] and out[5]["history"] == []


def test_conversations_with_many_rows_give_the_same(spark, monkeypatch):
    expected = sorted(triage.converse(messages(spark)).collect())
    monkeypatch.setattr(triage, "conversation_spans", lambda m: conversation_spans(m, 0.0, 1))
    assert sorted(triage.converse(messages(spark)).collect()) == expected


def test_contexts_keep_history_first_and_four_at_most(spark):
    row = spark.createDataFrame([(["a", "", "b", "c", "d"], "note", ["user: x"])], "hits array<string>, note string, history array<string>")
    out = row.select(A.gather_contexts(F.col("hits"), F.col("note"), F.col("history"))).first()[0]
    assert out == ["Previous turns:\nuser: x", "a", "b", "c"]


@pytest.mark.parametrize("held", [True, False])
def test_retrieval_only_where_needed(spark, monkeypatch, held):
    if not held:  # as with a large chunk table
        monkeypatch.setattr(triage, "small_chunk_hits", lambda chunks, k: None)
    rows = messages(spark).withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    chunks = spark.createDataFrame(
        [("a.md", "0", "text a", [1.0, 0.1], "Shipping_B"), ("b.md", "1", "text b", [1.0, 0.0], None)],
        "source string, chunk_id string, text string, vec array<double>, carrier string",
    )
    out = {r["msg_id"]: r for r in triage.answer_messages(rows, chunks).collect()}
    assert out[1]["citations"] == ["b.md#1", "a.md#0"] and out[4]["citations"] == ["a.md#0"]
    assert out[5]["citations"] == ["b.md#1", "a.md#0"]  # its carrier has no chunk
    assert out[2]["citations"] == [] and out[1]["contexts"] == ["text b", "text a"]
    plain = {r["msg_id"]: r for r in triage.plain_answers(rows, chunks, 1).collect()}
    assert plain[6]["citations"] == ["b.md#1"] and plain[6]["answer"].startswith("- Please share your tracking/waybill ID")


def test_generator_column(spark):
    def shout(text, contexts, tracking_id):
        return F.concat(F.upper(text), F.lit("… "), F.coalesce(tracking_id, F.lit("-")))

    out = {r["msg_id"]: r["answer"] for r in triage.answer_messages(messages(spark), generate=shout).collect()}
    assert out[6] == "THANKS - BYE... -"


def test_quote_from_columns(spark):
    rows = messages(spark).withColumn("origin_cc", F.lit("us")).withColumn("weight_kg", F.lit(2.3))
    out = triage.with_estimates(triage.understand(rows)).filter("quote IS NOT NULL").first()
    assert (out["quote"]["zone"], float(out["quote"]["price_usd"]), out["origin_cc"]) == ("INTERCONTINENT", 28.0, "us")


def run_stream(spark, tmp_path, rows, **options):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(inbox)
    job = stream_pipeline(stream_messages(spark, inbox, bytes_per_batch=5000), **options)
    query = (
        job.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(job.schema).parquet(out)


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    rows = messages(spark)
    streamed = run_stream(spark, tmp_path, [rows.filter(f"turn = {t}") for t in (1, 2, 3, 4)])
    columns = ["msg_id", "conv_id", "turn", "answer", "citations", "history"]
    assert sorted(streamed.select(*columns).collect()) == sorted(triage.converse(rows).select(*columns).collect())


@F.pandas_udf(ArrayType(DoubleType()))
def word_lengths(texts):
    return texts.map(lambda t: None if t is None else [float(len(t)), float(t.count("a"))])


def test_stream_retrieves_like_the_batch(spark, tmp_path):
    rows = messages(spark)
    chunks = spark.createDataFrame(
        [("a.md", "0", "text a", [1.0, 0.5], "Shipping_B"), ("b.md", "1", "text b", [1.0, 0.0], None)],
        "source string, chunk_id string, text string, vec array<double>, carrier string",
    )
    streamed = run_stream(spark, tmp_path, [rows], chunks=chunks, embed=word_lengths)
    columns = ["msg_id", "answer", "citations", "history"]
    found = sorted(streamed.select(*columns).collect())
    assert found == sorted(triage.converse(rows, chunks, word_lengths).select(*columns).collect())
    assert [len(r["citations"]) for r in found] == [2, 0, 0, 1, 2, 0]


def test_stream_with_a_generator(spark, tmp_path):
    def count(text, contexts, tracking_id):
        return f"{len(contexts)} “{tracking_id}” {contexts[0][:15] if contexts else ''} "

    streamed = run_stream(spark, tmp_path, [messages(spark)], generate=count)
    answers = {r["msg_id"]: r["answer"] for r in streamed.collect()}
    assert answers[1] == '0 "None"'
    assert answers[4] == '- Parsed tracking ID: AB12CD34 (carrier: Shipping_B).\n1 "AB12CD34" Previous turns:'


def test_memory_is_dropped_after_silence(spark, tmp_path):
    inbox = str(tmp_path / "in")
    messages(spark).filter("turn = 1").coalesce(1).write.parquet(inbox)
    query = (
        stream_pipeline(stream_messages(spark, inbox), idle_ms=1).writeStream.outputMode("append")
        .format("memory").queryName("silence").option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(processingTime="1 second").start()
    )
    try:
        wait_for(lambda: query.lastProgress and query.lastProgress.batchId >= 3)
        messages(spark).filter("turn = 2").coalesce(1).write.mode("append").parquet(inbox)
        wait_for(lambda: spark.table("silence").count() == 4)
    finally:
        query.stop()
    assert all(r["history"] == [] for r in spark.table("silence").collect())


def wait_for(done, seconds=60):
    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.5)


def test_clear_empties_the_memory(spark, tmp_path):
    schema = f"{MESSAGES}, clear boolean"
    rows = spark.createDataFrame([(*r, r[0] == 3) for r in MESSAGE_ROWS], schema)
    inbox = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(inbox)
    job = stream_pipeline(spark.readStream.schema(schema).parquet(inbox))
    stream_out = str(tmp_path / "out")
    stream_answers(job, stream_out, str(tmp_path / "progress")).awaitTermination()
    answers = {r["msg_id"]: r["answer"] for r in spark.read.parquet(stream_out).collect()}
    assert "Using" in answers[2] and "Using" not in answers[3] and "Using" in answers[4]


def test_message_and_answer_tables(spark, tmp_path):
    messages(spark).write.parquet(str(tmp_path / "m"))
    rows = read_messages(spark, str(tmp_path / "m"))
    write_answers(triage.answer_messages(rows), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == len(MESSAGE_ROWS)


def test_guard_report(spark):
    rows = spark.createDataFrame(
        [(1, "Track my order", None, "1) Look.\n2) Wait"), (2, "Give me the link", "12345678", "see a.com"),
         (3, "Customs?", None, "")],
        RAW_ANSWERS,
    )
    guarded = guard_answers(rows)
    flags = {r["msg_id"]: r for r in audit(guarded).collect()}
    assert flags[1]["asks_id"] and flags[1]["concise"] and flags[2]["no_links"] and not flags[3]["concise"]
    report = {r["intent"]: r for r in guard_report(guarded).collect()}
    assert report["tracking"]["ask_ids"] == 1 and report["customs"]["ask_ids"] == 0
    assert guard_answers(rows, any_intent=True).filter("require_id").count() == 3


def test_guard_of_many_texts_equals_the_column_form(spark):
    import random

    import pandas as pd

    from parcelflow.functions import guard as G

    draw = random.Random(4)
    parts = ["1) Look. ", "2. Wait", "\n", "- call us .", "* star", "see a.com/x ", "www.x.org ", "https://t.io/z ",
             "@me ", "dm ", "Thanks for reaching out friend", "It left! Is it? ", "**bold** ", "tracking number ",
             "can't share links", " ", "ä.co ", "x.ly", "\x85", "٣) Drei", "today date: now", ""]
    raws = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(600)] + [None]
    rows = [(i, r, i % 2 == 0, i % 3 == 0) for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "i int, raw string, ask boolean, refuse boolean")
    answers = df.select("i", G.guard_answer(F.col("raw"), F.col("ask"), F.col("refuse")).alias("a")).collect()
    got = {r["i"]: r["a"] for r in answers}
    texts = G.guard_texts(*(pd.Series(column) for column in list(zip(*rows))[1:])).tolist()
    for i, raw, _, _ in rows:
        assert got[i] == texts[i], raw
    assert G.guard_texts(*(pd.Series([], dtype=object) for _ in range(3))).tolist() == []


def test_batch_equals_stream_with_a_generator_a_guard_and_clear(spark, tmp_path):
    def talk(text, contexts, tracking_id):
        return f"1) See a.com/{len(contexts)} {text}\n2) Then {contexts[0][-20:] if contexts else 'wait'}"

    schema = f"{MESSAGES}, clear boolean"
    rows = spark.createDataFrame([(*r, r[0] == 3) for r in MESSAGE_ROWS], schema)
    inbox = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(inbox)
    for n, options in enumerate([{}, {"generate": talk}, {"generate": talk, "guarded": True}]):
        job = stream_pipeline(spark.readStream.schema(schema).parquet(inbox), **options)
        out = str(tmp_path / f"out{n}")
        job.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / f"progress{n}")
        ).trigger(availableNow=True).start().awaitTermination()
        streamed = sorted(spark.read.schema(job.schema).parquet(out).collect())
        assert streamed == sorted(triage.converse(rows, **options).select(*job.columns).collect())
    assert "a.com" not in "".join(r["answer"] for r in streamed)


def test_embedding_with_a_chunk_table_too_large_to_hold(spark):
    rows = messages(spark)
    chunks = spark.createDataFrame(
        [("a.md", str(i), f"text {i}", [1.0, i / 9], "Shipping_B" if i % 2 else None) for i in range(40)],
        "source string, chunk_id string, text string, vec array<double>, carrier string",
    )
    small, large = (
        sorted(
            triage.answer_messages(rows, chunks, embed=word_lengths, max_held=n)
            .select("msg_id", "answer", "citations").collect()
        )
        for n in (10_000, 2)
    )
    assert small == large and any(r["citations"] for r in small)


def test_a_task_keeps_k_hits_for_each_query(spark):
    from parcelflow.operators.similarity import _scan_chunks, topk
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        chunks = spark.range(200).selectExpr(
            "'s' source", "cast(id as string) chunk_id", "cast(null as string) carrier", "array(1.0D, id / 100) vec"
        ).coalesce(1)
        queries = spark.range(3).selectExpr("id query_id", "cast(null as string) carrier", "array(id + 1.0D, 1.0D) vec")
        ddl = "query_id bigint, rank int, source string, chunk_id string, score double"
        found = _scan_chunks(queries, chunks, 4, ddl, to_arrow_schema(StructType.fromDDL(ddl)), 100)
        assert found.count() == 12
        best = {tuple(r) for r in topk(queries, chunks, 4).select("query_id", "chunk_id").collect()}
        assert {(r["query_id"], r["chunk_id"]) for r in found.collect()} == best
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def chatty(spark, n_convs=40, seed=3):
    rng = random.Random(seed)
    rows, msg = [], 0
    for conv in range(n_convs):
        for turn in range(60 if conv == 0 else rng.randint(1, 9)):
            msg += 1
            rows.append((msg, conv, turn, rng.choice(["Track my order", "When? JO to AE eta", "hello", "price?"]), None, None, rng.random() < 0.1))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, f"{MESSAGES}, clear boolean")


def teller():
    def reply(text, contexts, tracking_id):
        import zlib

        return f"{len(contexts)}-{zlib.crc32(contexts[0].encode()) if contexts else 0}-{text[:4]}"

    return reply


telling = teller()  # not a function of this module, which executors cannot import

COLUMNS = ["msg_id", "conv_id", "turn", "answer", "citations", "history"]


def test_waves_equal_the_walk_in_few_calls(spark):
    rows, table = chatty(spark)
    ready = triage.ready_messages(table)
    calls = spark.sparkContext.accumulator(0)

    singly = M.one_by_one(telling)

    def many(texts, contexts, ids):
        calls.add(1)
        return singly(texts, contexts, ids)

    waves = M.answer_in_waves(ready, many, wave=1000)
    found = {r["msg_id"]: r for r in waves.collect()}
    first = {r["msg_id"]: r for r in ready.collect()}
    assert len(found) == len(rows) and calls.value < len(rows) / 1.5
    for conv in range(40):
        lines = []
        for msg, _, turn, text, _, _, clear in sorted((r for r in rows if r[1] == conv), key=lambda r: r[2]):
            lines = [] if clear else lines
            assert found[msg]["history"] == lines
            context = [A.HISTORY_HEADING + "\n".join(lines)] if lines else []
            reply = telling(text, context + list(first[msg]["contexts"]), None)
            assert found[msg]["answer"].split("\n")[-1] == reply
            lines = (lines + [f"user: {text}", f"assistant: {found[msg]['answer']}"])[-6:]
            assert found[msg]["lines"] == lines


@pytest.mark.parametrize("wave", [1, 7])
def test_small_buckets_and_messages_without_a_conversation(spark, wave):
    _, table = chatty(spark)
    table = table.withColumn("conv_id", F.when(F.col("conv_id") != 3, F.col("conv_id")))
    ready = triage.ready_messages(table)
    few, many = (
        sorted(M.answer_in_waves(ready, M.one_by_one(telling), wave=w).drop("lines").collect(), key=lambda r: r["msg_id"])
        for w in (wave, 10_000)
    )
    assert few == many and all(r["history"] == [] for r in few if r["conv_id"] is None)


def test_a_batch_hands_its_memory_to_a_stream(spark, tmp_path):
    _, table = chatty(spark)
    whole = {r["msg_id"]: r for r in triage.converse(table, generate=telling).select(*COLUMNS).collect()}
    early = table.filter("turn < 3")
    before = triage.converse(early, generate=telling)
    memory = triage.memory_of(early, before)
    inbox = str(tmp_path / "in")
    for low, high in ((3, 5), (5, 100)):
        table.filter(f"turn >= {low} AND turn < {high}").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    job = stream_pipeline(stream, generate=telling, memory=memory)
    writer = job.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = before.select(*COLUMNS).unionByName(spark.read.schema(job.schema).parquet(str(tmp_path / "out")).select(*COLUMNS))
    assert {r["msg_id"]: r for r in rows.collect()} == whole
    # The same table begins a conversation in batch as well.
    late = triage.converse(table.filter("turn >= 3"), generate=telling, memory=memory).select(*COLUMNS)
    assert {r["msg_id"]: r for r in before.select(*COLUMNS).unionByName(late).collect()} == whole


def test_one_query_answers_every_message_once_after_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "WHOLE_MEMORY", 2)
    _, table = chatty(spark)
    table = table.withColumn("vec", F.array(F.lit(1.0), F.col("turn") / 9))
    chunks = spark.createDataFrame(
        [("a.md", str(i), f"text {i}", [1.0, i / 9], None) for i in range(40)],
        "source string, chunk_id string, text string, vec array<double>, carrier string",
    )
    whole = {r["msg_id"]: r for r in triage.converse(table, chunks, generate=telling).select(*COLUMNS).collect()}
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "job")
    for low, high in ((0, 1), (1, 2), (2, 4), (4, 100)):
        table.filter(f"turn >= {low} AND turn < {high}").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(inbox)

    def run():
        answer_stream(
            stream, chunks, folder, generate=telling, max_held=2, trigger={"availableNow": True}
        ).awaitTermination()

    memory_of_batch = P.memory_after
    for failing in ("before the memory is written", "while answering"):
        with monkeypatch.context() as broken:
            if failing == "while answering":
                broken.setattr(P, "answer_in_waves", lambda *a, **k: 1 / 0)
            else:
                broken.setattr(P, "memory_after", lambda df: 1 / 0)
            with pytest.raises(Exception):
                run()
    assert memory_of_batch is P.memory_after
    running = len(spark.streams.active)
    run()
    assert len(spark.streams.active) == running
    rows = read_stream_answers(spark, folder).collect()
    assert len(rows) == len(whole) and {r["msg_id"]: r for r in rows} == whole


def test_a_large_chunk_table_needs_the_one_query(spark, tmp_path):
    messages(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    chunks = spark.createDataFrame(
        [("a.md", str(i), "t", [1.0, 0.0], None) for i in range(3)],
        "source string, chunk_id string, text string, vec array<double>, carrier string",
    )
    with pytest.raises(ValueError, match="answer_stream"):
        stream_pipeline(stream_messages(spark, str(tmp_path / "in")), chunks, embed=word_lengths, max_held=2)


def streamed(spark, folder, table, **options):
    table.coalesce(1).write.parquet(f"{folder}/in")
    job = stream_pipeline(spark.readStream.schema(table.schema).parquet(f"{folder}/in"), **options)
    writer = job.writeStream.format("parquet").option("path", f"{folder}/out")
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(job.schema).parquet(f"{folder}/out").select(*COLUMNS)


def test_a_stream_calls_for_buckets_of_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "STATE_BUCKETS", 2)
    _, table = chatty(spark)
    # Ids that a double does not hold, beside messages without a conversation, whose memory is one.
    table = table.withColumn("conv_id", F.when(F.col("conv_id") != 3, (1 << 60) + F.col("conv_id")))
    calls, singly = spark.sparkContext.accumulator(0), M.one_by_one(telling)

    def many(texts, contexts, ids):
        calls.add(1)
        return singly(texts, contexts, ids)

    found = {r["msg_id"]: r for r in streamed(spark, tmp_path, table, generate_many=many).collect()}
    named = table.withColumn("conv_id", F.coalesce("conv_id", F.lit(7)))
    whole = {r["msg_id"]: r for r in triage.converse(named, generate=telling).select(*COLUMNS).collect()}
    assert {m: r.asDict() | {"conv_id": r["conv_id"] or 7} for m, r in found.items()} == {m: r.asDict() for m, r in whole.items()}
    assert {r["conv_id"] for r in found.values()} == {None, *((1 << 60) + c for c in range(40) if c != 3)}
    assert calls.value <= 60 + 2 * 9 + 9  # waves of two buckets and of what has no conversation


def test_messages_of_one_file_are_understood_by_many_tasks(spark, tmp_path):
    table = spark.range(4000).selectExpr(
        "id msg_id", "id conv_id", "id turn", "'hello' text", "cast(null as string) tracking", "cast(null as string) carrier"
    )
    chunks = spark.createDataFrame(
        [("a.md", "0", "t", [1.0], None)], "source string, chunk_id string, text string, vec array<double>, carrier string"
    )
    seen = spark.sparkContext.accumulator(0)

    def embed(text):
        def partition(batches):
            seen.add(1)
            for batch in batches:
                yield batch.map(lambda t: [1.0])

        partition.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(partition, "array<double>")(F.coalesce(text, F.lit("")))

    assert streamed(spark, tmp_path, table, chunks=chunks, embed=embed).count() == 4000
    assert seen.value > 1


def test_messages_that_search_are_dealt_over_tasks(spark):
    rows = messages(spark).coalesce(1).withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    chunks = spark.createDataFrame(
        [("a.md", "0", "text a", [1.0, 0.1], None)], "source string, chunk_id string, text string, vec array<double>, carrier string"
    )
    tasks = 2 * spark.sparkContext.defaultParallelism
    for answered in (triage.answer_messages(rows, chunks), triage.plain_answers(rows, chunks)):
        assert answered.rdd.getNumPartitions() >= tasks
    assert triage.ready_messages(rows, chunks).rdd.getNumPartitions() >= tasks
    assert triage.answer_messages(rows).rdd.getNumPartitions() == 1


def test_clear_flags_need_no_python_and_equal_the_waves(spark):
    flagged = chatty(spark)[1].withColumn("clear", F.when(F.col("msg_id") % 7 != 0, F.col("msg_id") % 5 == 0))
    lone = flagged.filter("msg_id % 10 = 0").withColumns(
        {"msg_id": F.col("msg_id") + 100_000, "conv_id": F.lit(None).cast(dict(flagged.dtypes)["conv_id"])}
    )
    flagged = flagged.unionByName(lone)
    found = triage.converse(flagged)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    waves = M.answer_in_waves(triage.ready_messages(flagged)).drop("lines")
    order = lambda df: sorted(df.select("msg_id", "conv_id", "turn", "answer", "citations", "history").collect(), key=lambda r: r["msg_id"])
    assert order(found) == order(waves)
    assert {len(r["history"]) for r in order(found)} == {0, 2, 4, 6}


def test_a_generator_gets_what_it_reads_and_no_ready_answers(spark):
    found = triage.converse(chatty(spark)[1], generate_many=lambda texts, contexts, ids: [f"re {t}" for t in texts])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "answer_first" not in plan and "missing_id" not in plan
    assert "lines" not in plan
    assert all("re " in r["answer"] for r in found.collect())


def test_aliases_are_found_through_the_one_pass_for_all(spark):
    texts = ["with shippingB", "SHIPPING_A!", "no carrier", "xShippingA", "ſhippingC and Shipping_B", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = [r["c"] for r in rows.orderBy("i").select(carrier_alias(F.col("text")).alias("c")).collect()]
    assert found == ["Shipping_B", "Shipping_A", None, None, "Shipping_B", None]

"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelflow.config import V01, V02, from_mapping
from parcelflow.functions import chat, citations as C, guard as G, intents as I, text as T, vectors
from parcelflow.functions.citations import hit_fields
from parcelflow.functions.phrases import holds_any, ranks_of
from parcelflow.operators.chunks import chunk_text
from parcelflow.operators.dedup import keep_first, pair_digest
from parcelflow.operators.history import with_history
from parcelflow.operators.lanes import billable_kg, with_cents
from parcelflow.operators.pairs import reply_pairs
from parcelflow.operators.sections import chunk_sections
from parcelflow.operators.threads import thread_texts, threads
from parcelflow.operators.sample import flag_smallest, hash_order
from parcelflow.operators.similarity import topk
from parcelflow.operators.vector_index import index_for, load_index, search_index
from parcelflow.plans import guard, knowledge, lanes, triage
from parcelflow.plans.curate import curate, keyword_filter, manifest, map_pairs
from parcelflow.sources.datasets import load_pairs, number_source, read_tweets
from parcelflow.sources.knowledge import kb_files, overwrite_chunks, read_chunks
from parcelflow.sources.messages import stream_messages, write_answers
from parcelflow.sources.pairs import read_manifest, read_pairs, write_manifest, write_pairs
from parcelflow.staging import stage, staging_dir
from parcelflow.streaming.pipeline import answer_stream, read_stream_answers, stream_pipeline

from .inputs import COUNTRIES, SERVICES, derived, lanes as lane_input, table, with_message_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The prose holds no shipping words, so the keyword lists get a few syllables that do occur.
WORDS = ["lost", "rate", "id", "eta"]
CONFIG = replace(V01, keywords=(*V02.keywords, "ing", "lich", "ment"))
SPLIT_RATIO = 0.12
WIDE = ("aeoE", "ａｅ①Ｅ")  # the letters that stand for a, e, 1 and E
HELD = 10  # vectors, where the ways for large tables are forced
QUOTAS = {"src0": 30, "src1": 10, "src2": 1000000, "src3": 0, "src4": 7}
LABEL_MARK = "|"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def _listed(c: Column) -> Column:
    return F.array_join(c, LABEL_MARK)


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- text cleaning ------------------------------------------------------------------------------

@query
def normalize_text(spark, sf):
    text = T.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", _md5(text).alias("text_md5"))


@query
def normalize_wide(spark, sf):
    """Texts with wide, circled, joined and superscript characters, which NFKC takes apart."""
    odd = F.replace(F.translate("text", WIDE[0], WIDE[1]), F.lit("ti"), F.lit("ﬁ²"))
    text = T.normalize_text(odd)
    return table(spark, sf, "documents").select("doc_id", _md5(text).alias("text_md5"))


@query
def scrub_pii(spark, sf):
    scrubbed = T.scrub_pii(T.normalize_text(F.col("text")))
    return (
        table(spark, sf, "documents").select("doc_id", scrubbed.alias("t"))
        .select(
            "doc_id",
            F.regexp_count("t", F.lit(r"\[REDACTED_EMAIL\]")).cast("bigint").alias("emails"),
            F.regexp_count("t", F.lit(r"\[REDACTED_PHONE\]")).cast("bigint").alias("phones"),
            F.regexp_count("t", F.lit(r"\[REDACTED_ORDER\]")).cast("bigint").alias("orders"),
            _md5(F.col("t")).alias("text_md5"),
        )
    )


@query
def alias_carriers(spark, sf):
    """Names in documents and messages; 'the' and 'die' stand in for carriers that never occur."""
    names = ["dhl", "ups", "royal mail", "the", "die"]
    text = T.alias_carriers(F.col("text"), names, "Shipping_A")
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    messages = derived(spark, sf, "messages").select(
        F.lit("msg").alias("kind"), F.col("msg_id").alias("id"), "text"
    )
    return docs.unionByName(messages).select("kind", "id", _md5(text).alias("text_md5"))


@query
def detwitterize_agent(spark, sf):
    text = T.detwitterize_agent(F.col("raw"), True)
    return derived(spark, sf, "raw_answers").select("msg_id", text.alias("text"))


@query
def enforce_max_tokens(spark, sf):
    cut = T.enforce_max_tokens(F.col("text"), 100)
    return table(spark, sf, "documents").select(
        "doc_id", F.char_length(cut).cast("bigint").alias("chars"), _md5(cut).alias("text_md5")
    )


@query
def ascii_safe(spark, sf):
    answer = G.guard_answer(F.col("raw"), F.lit(False), I.wants_link(F.col("user_msg")))
    return derived(spark, sf, "raw_answers").select("msg_id", T.ascii_safe(answer).alias("answer"))


@query
def keyword_filter_docs(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(T.contains_any(F.col("text"), WORDS)).select("doc_id")


SYLLABLES = "the an er in re on ti ea or st ha nd ing ed ly is es en le la de qu".split()
PHRASES = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]


@query
def phrases_conversations(spark, sf):
    """Which of some ten thousand phrases each turn holds: the first in list order, and how many."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", ranks_of(F.col("text"), PHRASES).alias("ranks"))
    return turns.select(
        "conv_id", "turn", holds_any(F.col("text"), PHRASES).alias("any"), F.size("ranks").cast("bigint").alias("phrases"),
        F.get(F.array(*map(F.lit, PHRASES)), F.get("ranks", F.lit(0))).alias("first"),
    )


# --- pairs and curation -------------------------------------------------------------------------

def _pairs(spark, sf, tweets: str = "tweets") -> DataFrame:
    tweets = reply_pairs(derived(spark, sf, tweets)).withColumn("local_ord", F.col("src_key").cast("bigint"))
    corpus = derived(spark, sf, "instructions").select(
        F.col("o_orderkey").cast("string").alias("src_key"),
        F.col("instruction").alias("input_raw"),
        F.col("response").alias("assistant_raw"),
        F.col("o_orderkey").alias("local_ord"),
    )
    return number_source(tweets, "kaggle_twitter", 0).unionByName(number_source(corpus, "bitext_hf", 1))


@query
def reply_pairs_conversations(spark, sf):
    return reply_pairs(derived(spark, sf, "tweets"))


@query
def tweets_csv(spark, sf):
    """Reply pairs of tweets that went through a CSV file with quoted line breaks."""
    path = _scratch(spark, "tweets")
    derived(spark, sf, "tweets").write.option("header", True).option("quote", '"').option(
        "escape", '"'
    ).csv(path)
    return reply_pairs(read_tweets(spark, path))


@query
def tweets_csv_splits(spark, sf):
    """The same from one file that is read in splits."""
    path = _scratch(spark, "tweets")
    derived(spark, sf, "tweets").coalesce(1).write.option("header", True).option("quote", '"').option(
        "escape", '"'
    ).csv(path)
    return reply_pairs(read_tweets(spark, path, splits=True))


@query
def corpus_splits(spark, sf):
    """A settings file names a Parquet corpus by folder and a JSON corpus by files; one split of each is read."""
    path = _scratch(spark, "corpora")
    rows = derived(spark, sf, "instructions")
    for split, part in (("train", rows.filter("o_orderkey % 5 <> 0")), ("test", rows.filter("o_orderkey % 5 = 0"))):
        part.select("instruction", "response").write.parquet(f"{path}/parquet/{split}")
        part.select("instruction", "response").write.json(f"{path}/json/{split}")
    settings = {
        "datasets": [
            {"name": "a", "kind": "hf", "hf_repo": f"{path}/parquet", "split": "train"},
            {"name": "b", "kind": "hf", "path": f"{path}/json", "split": "test", "format": "json"},
        ],
        "filters": {"shipping_keywords": []}, "anonymize": {"carrier_aliases": [], "replace_with": ""},
        "tone": {"normalize_agent_style": False, "prepend_steps": False},
        "output": {"max_tokens": 1, "mini_size": 1, "val_ratio": 0.5},
    }
    pairs = load_pairs(spark, from_mapping(settings).datasets)
    return pairs.select("source", "input_raw", "assistant_raw")


@query
def union_of_sources(spark, sf):
    return _pairs(spark, sf).groupBy("source").agg(
        F.count("*").alias("pairs"), F.countDistinct("ord").alias("orders")
    )


@query
def keyword_filter_pairs(spark, sf):
    return keyword_filter(_pairs(spark, sf), CONFIG).select("source", "src_key")


@query
def map_pair(spark, sf):
    mapped = map_pairs(_pairs(spark, sf), CONFIG)
    return mapped.select("source", "src_key", "input", "assistant_response")


@query
def dedup_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return keep_first(docs, pair_digest(F.col("text")), "doc_id").select("doc_id")


@query
def dedup_messages(spark, sf):
    pairs = derived(spark, sf, "instructions")
    key = pair_digest(F.col("instruction"), F.col("response"))
    return keep_first(pairs, key, "o_orderkey")


def _doc_order(seed: str) -> Column:
    return hash_order(seed, F.col("doc_id"))


@query
def ratio_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    flagged = flag_smallest(
        docs.withColumn("key", _doc_order("42/pick")), "source", "key", QUOTAS
    )
    return flagged.filter("picked").select("doc_id", "source")


@query
def topup_sample(spark, sf):
    """Documents taken on top of the quota picks, as many as make up half the table."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    flagged = flag_smallest(
        docs.withColumn("key", _doc_order("42/pick")), "source", "key", QUOTAS
    )
    pool = flagged.withColumn("pool", F.when(~F.col("picked"), F.lit("all"))).withColumn(
        "more", _doc_order("42/top-up")
    )
    room = docs.count() // 2 - pool.filter("picked").count()
    return flag_smallest(pool, "pool", "more", {"all": room}, "topped").filter("topped").select("doc_id")


@query
def train_val_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit("all").alias("pool"))
    n_val = max(1, int(docs.count() * SPLIT_RATIO))
    split = flag_smallest(docs.withColumn("key", _doc_order("42/final")), "pool", "key", {"all": n_val}, "val")
    return split.select("doc_id", F.when(F.col("val"), "val").otherwise("train").alias("split"))


@query
def curated_pairs(spark, sf):
    return curate(_pairs(spark, sf), CONFIG).select("input", "assistant_response", "source", "split")


@query
def curated_pairs_repeated_ids(spark, sf):
    """Curation where customers' ids are missing or repeated: every pair still counts once."""
    pairs = _pairs(spark, sf, "repeated_tweets")
    return curate(pairs, CONFIG).select("input", "assistant_response", "source", "split")


@query
def reply_pairs_hot(spark, sf):
    """Every message as a reply to one of eight: nearly all replies are hot and salted."""
    asked = derived(spark, sf, "messages").select(
        F.col("msg_id").cast("string").alias("tweet_id"), F.lit("True").alias("inbound"), "text",
        F.concat(F.lit("r"), (F.col("msg_id") % 8).cast("string")).alias("response_tweet_id"),
    )
    replies = spark.range(6).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("tweet_id"), F.lit("False").alias("inbound"),
        F.concat(F.lit("reply "), F.col("id").cast("string")).alias("text"),
        F.lit(None).cast("string").alias("response_tweet_id"),
    )
    return reply_pairs(asked.unionByName(replies), hot_rows=50)


@query
def curated_manifest(spark, sf):
    """The manifest after a round trip through its file."""
    path = _scratch(spark, "manifest")
    write_manifest(manifest(curate(_pairs(spark, sf), CONFIG), CONFIG), path)
    return read_manifest(spark, path).select(
        "total_pairs", "train_pairs", "val_pairs",
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("ratios")),
                lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
            ),
            LABEL_MARK,
        ).alias("ratios"),
    )


@query
def pairs_jsonl(spark, sf):
    """Curated pairs after a round trip through the JSON-lines files."""
    path = _scratch(spark, "pairs")
    write_pairs(curate(_pairs(spark, sf), CONFIG), path, "shuffle_key")
    return read_pairs(spark, path)


@query
def tweet_threads(spark, sf):
    """Thread and turn of every tweet: chains, branches, replies that are not there, and circles."""
    placed = threads(derived(spark, sf, "threaded_tweets"))
    return placed.select("tweet_id", "thread", "turn")


@query
def thread_chat_text(spark, sf):
    """Training text of whole threads."""
    tweets = derived(spark, sf, "threaded_tweets")
    return thread_texts(tweets, threads(tweets)).select("thread", "tweets", _md5(F.col("text")).alias("text_md5"))


@query
def pair_json(spark, sf):
    row = F.to_json(F.struct(F.col("input_raw").alias("input"), F.col("assistant_raw").alias("assistant_response")))
    return reply_pairs(derived(spark, sf, "tweets")).select("src_key", row.alias("json"))


@query
def chat_text(spark, sf):
    pairs = reply_pairs(derived(spark, sf, "tweets"))
    return pairs.select("src_key", chat.chat_text(F.col("input_raw"), F.col("assistant_raw")).alias("text"))


# --- knowledge base -----------------------------------------------------------------------------

@query
def kb_file_filter(spark, sf):
    return kb_files(derived(spark, sf, "kb_files")).select("source", "carrier", _md5(F.col("text")).alias("text_md5"))


@query
def chunk_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.strip(F.col("text")).alias("text"))
    return chunk_text(docs).select("doc_id", "chunk_id", _md5(F.col("text")).alias("text_md5"))


@query
def chunk_documents_small(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunk_text(docs, size=100, overlap=70).groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("chars")
    )


@query
def chunk_by_heading(spark, sf):
    """Sections of markdown files packed to 600 characters, questions with their answers."""
    chunks = chunk_sections(derived(spark, sf, "kb_markdown"), ["source"], size=600)
    return chunks.select(
        "source", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.array_join("headings", " > ").alias("headings"),
        _md5(F.col("body")).alias("body_md5"), _md5(F.col("text")).alias("text_md5"),
    )


def _embedded(text: Column) -> Column:
    return F.array(F.char_length(text).cast("float"), F.octet_length(text).cast("float"))


def _second_ingest(spark, sf):
    """A chunk table after an ingest and a second one, in which some files are changed, new or gone."""
    path = _scratch(spark, "kb")
    # Files of Shipping_C and those without a carrier are the same both times.
    number = F.regexp_extract("source", r"_([0-9]+)\.md$", 1).cast("bigint")
    files = kb_files(derived(spark, sf, "kb_files")).withColumn("n", number)
    first = files.filter("NOT (carrier = 'Shipping_A' AND n % 50 = 1)")
    text = F.when((F.col("carrier") == "Shipping_B") & (F.col("n") % 40 == 2), F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    second = files.filter("NOT (carrier = 'Shipping_A' AND n % 50 = 11)").withColumn("text", text)
    knowledge.ingest_changes(knowledge.chunk_files(first.drop("n")).drop("vec"), path, _embedded)
    return path, knowledge.ingest_changes(knowledge.chunk_files(second.drop("n")).drop("vec"), path, _embedded)


@query
def ingest_changes(spark, sf):
    """The chunk table after the second ingest."""
    path, _ = _second_ingest(spark, sf)
    return read_chunks(spark, path).select(
        "source", F.col("chunk_id").cast("bigint").alias("chunk_id"), "carrier", _md5(F.col("text")).alias("text_md5"),
        F.get("vec", F.lit(0)).cast("bigint").alias("chars"), F.get("vec", F.lit(1)).cast("bigint").alias("bytes"),
    )


@query
def ingest_report(spark, sf):
    """What the second ingest cost: texts that were embedded, carriers that were written."""
    _, done = _second_ingest(spark, sf)
    row = (done.chunks, done.embedded, "|".join(c or "" for c in done.carriers))
    return spark.createDataFrame([row], "chunks bigint, embedded bigint, carriers string")


@query
def ingest_counts(spark, sf):
    chunks = knowledge.chunk_files(kb_files(derived(spark, sf, "kb_files")))
    return knowledge.ingest_counts(chunks)


@query
def chunk_table(spark, sf):
    """The chunk table after a rewrite, read back within one carrier partition and without one."""
    path = _scratch(spark, "chunks")
    overwrite_chunks(derived(spark, sf, "chunks"), path)
    return read_chunks(spark, path).groupBy("carrier", "source").agg(
        F.count("*").alias("chunks"), F.min("chunk_id").alias("first_id")
    )


@query
def knn_topk(spark, sf):
    """Five nearest vectors of every vector, itself included."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return topk(queries, derived(spark, sf, "chunks").drop("carrier"), 5).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "source", "chunk_id",
        F.round("score", 4).alias("score"),
    )


@query
def knn_carrier_fallback(spark, sf):
    """Four nearest within a carrier; Shipping_C has no chunk and falls back to all."""
    carrier = F.element_at(
        F.array(*[F.lit(c) for c in ("Shipping_A", "Shipping_B", "Shipping_C", None)]),
        (F.col("vec_id") % 4 + 1).cast("int"),
    )
    queries = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), carrier.alias("carrier")
    )
    return topk(queries, derived(spark, sf, "chunks"), 4).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "source", "chunk_id"
    )


def _vector_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


@query
def vector_index_exact(spark, sf):
    """``knn_topk`` from the index: nearest cells first, then those that may hold a better hit."""
    chunks = derived(spark, sf, "chunks").drop("carrier")
    index = index_for(chunks, "index")
    found = search_index(_vector_queries(spark, sf), load_index(spark, index.path), 5, exact=True)
    return found.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "source", "chunk_id",
        F.round("score", 4).alias("score"),
    )


@query
def vector_index_carriers(spark, sf):
    """``knn_carrier_fallback`` from the index, where the questions are too many to be held: blocks of a cell meet."""
    carrier = F.element_at(
        F.array(*[F.lit(c) for c in ("Shipping_A", "Shipping_B", "Shipping_C", None)]),
        (F.col("query_id") % 4 + 1).cast("int"),
    )
    queries = _vector_queries(spark, sf).withColumn("carrier", carrier)
    index = index_for(derived(spark, sf, "chunks"), "index")
    return search_index(queries, index, 4, exact=True, max_broadcast=HELD).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "source", "chunk_id"
    )


@query
def vector_index_recall(spark, sf):
    """Share of the exact hits that the probed cells hold, for a tenth of the vectors; their own row does not count."""
    chunks = derived(spark, sf, "chunks").drop("carrier")
    queries = _vector_queries(spark, sf).filter("query_id % 10 = 0")
    index = index_for(chunks, "index")
    other = F.col("chunk_id") != F.col("query_id").cast("string")
    wanted = topk(queries, chunks, 6).filter(other).select("query_id", "chunk_id")
    probed = search_index(queries, index, 6).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    met = wanted.join(probed, ["query_id", "chunk_id"], "left")
    return met.agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_wanted"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"),
    )


@query
def search_hits(spark, sf):
    queries = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")
    )
    return knowledge.search(queries, derived(spark, sf, "chunks"), 3).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "text",
        C.citation_ref(F.col("source"), F.col("chunk_id")).alias("ref"),
    )


@query
def citation_labels(spark, sf):
    """All shapes of labels, from hits whose parts are sometimes missing."""
    hits = derived(spark, sf, "chunks").selectExpr(
        "chunk_id AS id",
        "CASE WHEN CAST(chunk_id AS BIGINT) % 3 <> 0 THEN source WHEN CAST(chunk_id AS BIGINT) % 2 = 0 THEN '' END AS source",
        "CASE WHEN CAST(chunk_id AS BIGINT) % 5 <> 0 THEN chunk_id WHEN CAST(chunk_id AS BIGINT) % 2 = 0 THEN '' END AS chunk_id",
    )
    source, chunk = F.col("source"), F.col("chunk_id")
    return hits.select(
        "id", C.citation_ref(source, chunk).alias("ref"), C.citation_label(source, chunk).alias("label")
    )


# --- triage -------------------------------------------------------------------------------------

@query
def parse_tracking(spark, sf):
    rows = triage.tracking_rows(derived(spark, sf, "messages"))
    return rows.select("msg_id", F.col("pos").cast("bigint").alias("pos"), "id", "raw", "carrier")


@query
def parse_tracking_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), "text")
    return triage.tracking_rows(docs).select("msg_id", F.col("pos").cast("bigint").alias("pos"), "id", "raw")


@query
def ids_per_carrier(spark, sf):
    return triage.ids_per_carrier(derived(spark, sf, "messages"))


@query
def intent_counts(spark, sf):
    return triage.intent_counts(derived(spark, sf, "messages"))


@query
def intent_conversations(spark, sf):
    """Intents of real turns."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return triage.intent_counts(turns.withColumn("tracking", F.lit(None).cast("string")))


@query
def message_routing(spark, sf):
    known = triage.understand(derived(spark, sf, "messages"))
    return known.select(
        "msg_id", "carrier", "intent", "missing_id", "wants_link", "notes",
        I.missing_id_any_intent(F.col("text")).alias("missing_any"),
        F.get("ids", F.lit(0)).alias("first_id"), _listed(F.col("ids")).alias("ids"),
        _listed(F.col("needs")).alias("needs"),
    )


@query
def message_lanes(spark, sf):
    lane, strict = I.lane(F.col("text")), I.lane(F.col("text"), strict=True)
    return derived(spark, sf, "messages").select(
        "msg_id", lane["origin_cc"].alias("origin_cc"), lane["dest_cc"].alias("dest_cc"),
        strict["origin_cc"].alias("strict_origin"), strict["dest_cc"].alias("strict_dest"),
        I.service_word(F.col("text")).alias("service"),
    )


@query
def message_estimates(spark, sf):
    known = triage.with_estimates(triage.understand(derived(spark, sf, "messages")))
    return known.filter("eta IS NOT NULL OR quote IS NOT NULL").select(
        "msg_id", "eta.origin_cc", "eta.dest_cc", F.col("eta.service").alias("eta_service"),
        F.col("eta.min_days").cast("bigint").alias("min_days"),
        F.col("eta.max_days").cast("bigint").alias("max_days"),
        "quote.zone", F.col("quote.price_usd").cast("double").alias("price_usd"), "quote.billable_kg",
    )


@query
def message_quotes(spark, sf):
    """Quotes of messages whose rows say the lane, the service and the weight."""
    nation = lambda key: F.expr(f"CAST({key} % 25 AS BIGINT)")
    codes = F.array(*[F.lit(c) for c in COUNTRIES])
    rows = derived(spark, sf, "messages").withColumns(
        {
            "origin_cc": F.get(codes, nation("conv_id").cast("int")),
            "dest_cc": F.get(codes, nation("msg_id").cast("int")),
            "service": F.get(F.array(*map(F.lit, SERVICES)), (F.col("msg_id") % 3).cast("int")),
            "weight_kg": (F.col("msg_id") % 40).cast("double") / 8,
        }
    )
    quote = triage.with_estimates(triage.understand(rows)).filter("quote IS NOT NULL").select("msg_id", "quote.*")
    return quote.select(
        "msg_id", "service", "zone", F.col("billable_kg").cast("double").alias("billable_kg"),
        F.col("price_usd").cast("double").alias("price_usd"),
    )


@query
def cosine_columns(spark, sf):
    """Similarity of neighbouring vectors by column arithmetic."""
    rows = table(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    score = F.round(vectors.cosine(F.col("embedding"), F.col("other")), 9)
    return rows.join(after, "vec_id").select("vec_id", score.alias("score"))


@query
def stored_hits(spark, sf):
    """Fields of stored hits of which some are missing."""
    missing = lambda c, n: F.when(F.col("vec_id") % n != 0, c)
    fields = hit_fields(
        missing(F.concat(F.lit("kb"), F.col("label").cast("string")), 3), missing(F.lit("file.md"), 2),
        missing(F.col("vec_id"), 5), missing(F.col("label"), 7), missing(F.get("embedding", F.lit(0)), 4),
    )
    return table(spark, sf, "embeddings").select("vec_id", *[c.alias(n) for n, c in fields.items()])


@query
def history_hot(spark, sf):
    """History where every conversation is cut into spans of two rows."""
    rows = with_history(table(spark, sf, "conversations"), share=1e-9, span_rows=2)
    return rows.select("conv_id", "turn", "role", F.array_join("history", "\n").alias("history"))


@query
def chat_text_conversation(spark, sf):
    """Training text of whole conversations."""
    turns = F.collect_list(F.struct("turn", "role", "text"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", chat.conversation_text(F.col("turns")).alias("text")
    )


@query
def history_last6(spark, sf):
    rows = with_history(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", "role", F.array_join("history", "\n").alias("history"))


def _answers(answered: DataFrame) -> DataFrame:
    return answered.select("msg_id", "answer", _listed(F.col("citations")).alias("citations"))


def _messages_with_vectors(spark, sf):
    return with_message_vectors(spark, sf, derived(spark, sf, "messages"))


@query
def triage_answers(spark, sf):
    return _answers(triage.answer_messages(_messages_with_vectors(spark, sf), derived(spark, sf, "chunks")))


@query
def triage_answers_blocks(spark, sf):
    """The same where neither side of the search is small: blocks of both meet."""
    found = triage.answer_messages(
        _messages_with_vectors(spark, sf), derived(spark, sf, "chunks"), max_held=HELD
    )
    return _answers(found)


@query
def answer_sink(spark, sf):
    """Answers after a round trip through their table."""
    messages = _messages_with_vectors(spark, sf)
    path = _scratch(spark, "answers")
    write_answers(triage.answer_messages(messages, derived(spark, sf, "chunks")), path)
    return _answers(spark.read.parquet(path))


@query
def guarded_replies(spark, sf):
    """What a generator says, cleaned: a link and numbered steps in every reply."""
    def generate(text, contexts, tracking_id):
        return F.concat(F.lit("1) See https://track.example.com/x now.\n2) "), text, F.lit("\n3. Wait -"))

    replies = triage.answer_messages(derived(spark, sf, "messages"), generate=generate, guarded=True)
    return replies.select("msg_id", "reply")


@query
def plain_answers(spark, sf):
    return _answers(triage.plain_answers(_messages_with_vectors(spark, sf), derived(spark, sf, "chunks")))


@query
def prompts(spark, sf):
    """Prompts of messages with their retrieved contexts."""
    answered = triage.answer_messages(_messages_with_vectors(spark, sf), derived(spark, sf, "chunks"))
    return answered.select(
        "msg_id",
        chat.prompt_text(F.col("text"), F.col("contexts")).alias("prompt"),
        chat.sectioned_prompt(F.col("text"), F.col("contexts"), F.get("ids", F.lit(0))).alias("sections"),
    )


def _with_memory(answered: DataFrame) -> DataFrame:
    return answered.select("msg_id", "conv_id", "turn", "answer", F.array_join("history", "\n").alias("history"))


@query
def conversation_answers(spark, sf):
    return _with_memory(triage.converse(derived(spark, sf, "messages")))


def _telling(texts, contexts, tracking_ids):
    """Replies that hang on every word of the history."""
    import hashlib

    def reply(context, tracking_id):
        mark = hashlib.md5(context[0].encode()).hexdigest()[:8] if len(context) else "-"
        return f"{len(context)} {mark} {tracking_id or '-'}"

    return [reply(c, t) for c, t in zip(contexts, tracking_ids)]


@query
def conversation_generator(spark, sf):
    """Conversations with a generator, wave by wave: a reply hangs on all replies before it."""
    tell = _telling
    messages = derived(spark, sf, "messages")
    return _with_memory(triage.converse(messages, generate_many=lambda *columns: tell(*columns)))


@query
def stream_handover(spark, sf):
    """The same conversations, begun as a table and gone on with as a stream that takes over their memory."""
    tell = _telling
    many = lambda *columns: tell(*columns)
    messages = stage(derived(spark, sf, "messages"), "messages")
    middle = (messages.agg(F.max("turn")).first()[0] or 0) // 2
    early, late = messages.filter(F.col("turn") <= middle), messages.filter(F.col("turn") > middle)
    before = stage(triage.converse(early, generate_many=many), "early")
    memory = stage(triage.memory_of(early, before), "memory")
    after = _finished(_inbox(spark, late), lambda stream: stream_pipeline(stream, generate_many=many, memory=memory))
    return _with_memory(before.unionByName(after))


@query
def stream_clear(spark, sf):
    """Messages that empty the memory of their conversation, as a stream in three micro-batches."""
    messages = stage(derived(spark, sf, "messages").withColumn("clear", F.col("msg_id") % 5 == 0), "messages")
    return _with_memory(_finished(_inbox(spark, messages), stream_pipeline))


@query
def conversation_clear(spark, sf):
    """The same over the whole table."""
    return _with_memory(triage.converse(derived(spark, sf, "messages").withColumn("clear", F.col("msg_id") % 5 == 0)))


def _with_citations(answered: DataFrame) -> DataFrame:
    return answered.select(
        "msg_id", "conv_id", "turn", "answer", F.array_join("history", "\n").alias("history"),
        _listed(F.col("citations")).alias("citations"),
    )


@query
def conversation_retrieval(spark, sf):
    """Conversations with memory and retrieval."""
    answered = triage.converse(_messages_with_vectors(spark, sf), derived(spark, sf, "chunks"))
    return _with_citations(answered)


def _inbox(spark, messages: DataFrame) -> DataFrame:
    """A stream of three files that come one by one, by turn."""
    folder = _scratch(spark, "inbox")
    highest = messages.agg(F.max("turn")).first()[0] or 0
    third = F.least(F.floor(F.col("turn") * 3 / (highest + 1)), F.lit(2))
    for i in range(3):
        messages.filter(third == i).repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _finished(stream: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream job says about what is there."""
    spark, out = stream.sparkSession, job(stream)
    path = _scratch(spark, "outbox")
    (
        out.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", _scratch(spark, "progress"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(out.schema).parquet(path)


@query
def stream_retrieval(spark, sf):
    """Several micro-batches with memory and retrieval, so that state is read back."""
    messages = stage(_messages_with_vectors(spark, sf), "messages")
    chunks = derived(spark, sf, "chunks")
    return _with_citations(_finished(_inbox(spark, messages), lambda stream: stream_pipeline(stream, chunks)))


@query
def stream_retrieval_blocks(spark, sf):
    """The same with a chunk table too large to be held: one query searches, answers and remembers."""
    messages = stage(_messages_with_vectors(spark, sf), "messages")
    folder = _scratch(spark, "answers")
    job = answer_stream(
        _inbox(spark, messages), derived(spark, sf, "chunks"), folder, max_held=HELD, trigger={"availableNow": True}
    )
    job.awaitTermination()
    return _with_citations(read_stream_answers(spark, folder))


@query
def stream_answers(spark, sf):
    """The message job as a stream over message files, with conversation memory as state."""
    inbox, out = _scratch(spark, "inbox"), _scratch(spark, "outbox")
    derived(spark, sf, "messages").write.parquet(inbox)
    job = stream_pipeline(stream_messages(spark, inbox))
    (
        job.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", _scratch(spark, "progress"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return _with_memory(spark.read.schema(job.schema).parquet(out))


# --- lanes --------------------------------------------------------------------------------------

@query
def eta_by_lane(spark, sf):
    return lanes.eta_by_lane(lane_input(spark, sf)).select(
        "origin_cc", "dest_cc", "service", F.col("shipments").cast("bigint").alias("shipments"),
        F.col("min_days").cast("bigint").alias("min_days"), F.col("max_days").cast("bigint").alias("max_days"),
    )


@query
def quote_by_zone(spark, sf):
    return lanes.quote_by_zone(lane_input(spark, sf, weighed=True)).select(
        "zone", "service", F.col("shipments").cast("bigint").alias("shipments"),
        F.col("price_usd").cast("double").alias("price_usd"),
        F.col("billed_kg").cast("double").alias("billed_kg"),
    )


@query
def billable_weight(spark, sf):
    kg = billable_kg(F.col("weight_kg"), F.col("l_cm"), F.col("w_cm"), F.col("h_cm"))
    rows = derived(spark, sf, "line_weights").withColumn("kg", kg)
    return with_cents(rows, "kg", "billable_kg").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "billable_kg"
    )


# --- guard --------------------------------------------------------------------------------------

@query
def guard_answers(spark, sf):
    return guard.guard_answers(derived(spark, sf, "raw_answers")).select("msg_id", "intent", "answer")


@query
def guard_conversations(spark, sf):
    """Assistant turns as raw answers to the user turn before them."""
    raw = reply_pairs(derived(spark, sf, "tweets")).select(
        F.col("src_key").cast("bigint").alias("msg_id"), F.col("input_raw").alias("user_msg"),
        F.lit(None).cast("string").alias("tracking"), F.col("assistant_raw").alias("raw"),
    )
    return guard.guard_answers(raw).select("msg_id", "answer")


@query
def guard_report(spark, sf):
    return guard.guard_report(guard.guard_answers(derived(spark, sf, "raw_answers")))


@query
def guard_eval(spark, sf):
    """Pass counters with the evaluation set's rule for a missing ID."""
    return guard.guard_report(guard.guard_answers(derived(spark, sf, "raw_answers"), any_intent=True))


@query
def answer_audit(spark, sf):
    """Audit flags of the raw answers as they come."""
    raw = derived(spark, sf, "raw_answers").withColumnRenamed("raw", "answer")
    return guard.audit(raw).select(
        "msg_id", "asks_id", "no_links", "concise", _listed(F.col("blocked")).alias("blocked"),
        G.contains_linkish(F.col("answer"), more_domains=True).alias("more_links"),
    )



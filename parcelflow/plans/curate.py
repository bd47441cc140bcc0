"""The dataset job: filter, clean, deduplicate, rebalance, split, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Curation
from ..functions import text as T
from ..operators.dedup import keep_first, pair_digest
from ..operators.sample import flag_smallest, hash_order
from ..sources.datasets import load_pairs
from ..sources.pairs import read_manifest, write_manifest, write_pairs
from ..staging import scratch, stage

# Chosen rows (a number, a word and a key each) sent to every task instead of moving the texts.
MAX_SENT_ROWS = 200_000


def keyword_filter(pairs: DataFrame, cfg: Curation) -> DataFrame:
    """Pairs whose raw user or agent text holds a keyword."""
    words = list(cfg.keywords)
    return pairs.filter(
        T.contains_any(F.col("input_raw"), words) | T.contains_any(F.col("assistant_raw"), words)
    )


def map_pairs(pairs: DataFrame, cfg: Curation) -> DataFrame:
    """Replace the raw texts by the cleaned ``input`` and ``assistant_response``."""
    def clean(raw: str):
        scrubbed = T.scrub_pii(T.normalize_text(F.col(raw)))
        return T.alias_carriers(scrubbed, list(cfg.carrier_names), cfg.carrier_alias)

    agent = clean("assistant_raw")
    if cfg.normalize_agent_style:
        agent = T.detwitterize_agent(agent, cfg.prepend_steps)
    others = [c for c in pairs.columns if c not in ("input_raw", "assistant_raw")]
    return pairs.select(
        *others,
        T.enforce_max_tokens(clean("input_raw"), cfg.max_tokens).alias("input"),
        T.enforce_max_tokens(agent, cfg.max_tokens).alias("assistant_response"),
    )


def select_rows(rows: DataFrame, cfg: Curation) -> DataFrame:
    """(row, split, shuffle_key) of the chosen rows; ``rows`` has row (unique), ord, content and source.

    Rows with the same ``ord`` are told apart by their content.  Each source gives its quota of seeded-random rows; the rest up to ``mini_size`` comes from all
    rows not yet chosen; the first of the final order are the validation set.
    """
    def key(purpose: str):
        return F.concat(hash_order(f"{cfg.seed}/{purpose}", F.col("ord")), F.lit(":"), F.col("content"))

    quotas = cfg.quotas()
    picked = flag_smallest(rows.withColumn("pick_key", key("pick")), "source", "pick_key", quotas)
    pool = picked.withColumn("pool", F.when(~F.col("picked"), F.lit("all")))
    room = cfg.mini_size - pool.filter("picked").count()
    chosen = (
        flag_smallest(pool.withColumn("more_key", key("top-up")), "pool", "more_key", {"all": room}, "topped")
        .filter("picked OR topped")
        .select("row", F.lit("all").alias("pool"), key("final").alias("shuffle_key"))
    )
    chosen = stage(chosen, "chosen")  # no more than ``mini_size`` rows, or the quotas' sum
    if room < 0:
        chosen = flag_smallest(chosen, "pool", "shuffle_key", {"all": cfg.mini_size}, "kept").filter("kept")
    n_val = max(1, int(chosen.count() * cfg.val_ratio))
    return flag_smallest(chosen, "pool", "shuffle_key", {"all": n_val}, "is_val").select(
        "row", F.when(F.col("is_val"), "val").otherwise("train").alias("split"), "shuffle_key"
    )


def curate(pairs: DataFrame, cfg: Curation) -> DataFrame:
    """RAW_PAIRS to (input, assistant_response, source, split, shuffle_key).

    The texts are cleaned once and staged under a row number.  Deduplication reads them for digests;
    selection reads narrow rows; texts of rows that were not chosen do not move if the chosen ones are
    few enough to be sent to the tasks.  Rows whose ``ord`` is shared, as of customers without an id or
    with a repeated one, stay apart.
    """
    mapped = map_pairs(keyword_filter(pairs, cfg), cfg).withColumn("row", F.monotonically_increasing_id())
    cleaned = stage(mapped, "cleaned")  # written, so that row numbers hold
    texts = [F.col("input"), F.col("assistant_response")]
    content = F.sha2(F.to_json(F.array(*texts)), 256)
    narrow = ["ord", "content", "source", "row"]
    kept = stage(keep_first(cleaned.withColumn("content", content), pair_digest(*texts), "ord", narrow), "kept")
    chosen = stage(select_rows(kept, cfg), "split")
    if chosen.offset(MAX_SENT_ROWS).isEmpty():
        chosen = F.broadcast(chosen)
    return cleaned.select("row", "input", "assistant_response", "source").join(chosen, "row").drop("row")


def manifest(curated: DataFrame, cfg: Curation) -> DataFrame:
    """One row: total, train and validation counts and the ratios."""
    ratios = F.create_map(*[F.lit(v) for kv in cfg.ratios.items() for v in kv])
    return curated.agg(
        F.count("*").alias("total_pairs"),
        F.count_if(F.col("split") == "train").alias("train_pairs"),
        F.count_if(F.col("split") == "val").alias("val_pairs"),
    ).withColumn("ratios", ratios)


def build_dataset(spark: SparkSession, cfg: Curation, out: str) -> DataFrame:
    """Read, curate and write one dataset version; returns the manifest as written."""
    with scratch(spark):
        curated = stage(curate(load_pairs(spark, cfg.datasets), cfg), "curated")
        write_pairs(curated, f"{out}/pairs", "shuffle_key")
        write_manifest(manifest(curated, cfg), f"{out}/manifest")
    return read_manifest(spark, f"{out}/manifest")

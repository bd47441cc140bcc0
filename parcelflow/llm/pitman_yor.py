"""A language model of hierarchical Pitman-Yor processes, learned and applied by Spark jobs.

A text is a row of words and an end.  One hierarchy makes up its probability:
every observed pair of words, and every word, is the context of a restaurant.

A restaurant of two words has that of the latter word as its parent, and that has the root, whose base is uniform
over the words learned, the end, and one more for every word never seen.  Customers are seated by Gibbs sampling
(``contexts``, ``tables``): in a sweep all customers of every dish are seated anew, level by level.  Predictive
probabilities are averaged over the kept sweeps, each level's shares and weights by themselves.

Sizes.  Words and contexts are tables: n-grams are counted by partial aggregation and a shuffle into parts, texts'
n-grams go to the same parts to be scored.  The KNOWN most frequent words (a fixed number) are broadcast with their
counts; others are joined by hash.  Only they and totals pass the driver.

A null or empty text is the end alone.  Rows without an id are learned from.  Rows that repeat an id are
scored one by one.  If nothing is left to learn from, all probabilities are those of the bases.  Empty
tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.staging import stage

from . import contexts
from .common import bounded_batches, pieces, whole_texts, words_of

KNOWN = 1 << 19
FEW_BYTES = 64


@dataclass(frozen=True)
class Settings:
    known: int = KNOWN
    discount: float = 0.7
    strength: float = 1.0
    burn: int = 3
    kept: int = 4
    folds: int = 7
    held_fold: int = 2
    part: int = 1 << 19  # tokens in a part, about
    split: int = 1 << 20  # a word before more tokens than this is dealt by the next word as well
    merge: int = 1 << 19  # tokens whose n-grams are counted together, about


# --- words of texts ---------------------------------------------------------------------------------


def _hashes(words: pa.Array) -> np.ndarray:
    """Of words of a few bytes all at once, eight bytes at a time."""
    words = words.cast(pa.binary())
    begin = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    begin, size = begin[:-1], np.diff(begin)
    data = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # from every byte on
    found = contexts.mix(size)
    left = np.flatnonzero(size <= FEW_BYTES)
    for at in range(0, FEW_BYTES, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        unused = np.maximum(8 - (size[left] - at), 0).astype(np.uint64) << np.uint64(3)
        found[left] = contexts.mix(found[left] ^ (eight[begin[left] + at] << unused))
    long_ = np.flatnonzero(size > FEW_BYTES)
    if len(long_):
        found[long_] = [xxhash.xxh3_64_intdigest(w) for w in words.take(pa.array(long_)).to_pylist()]
    return found


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in turn, and its text."""
    words, text = words_of(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), text


@dataclass
class Head:
    """The end and the most frequent words, by rank: their counts and log probabilities without a context."""

    counts: np.ndarray  # of rank 0, a word that has none, nothing is known
    scores: np.ndarray

    @cached_property
    def probabilities(self) -> np.ndarray:
        return 10.0**self.scores


# --- jobs ------------------------------------------------------------------------------------------


def held_out(use: Settings) -> Column:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % use.folds
    return F.coalesce(fold == use.held_fold, F.lit(False))


def _chunks(batch: pa.RecordBatch, use: Settings) -> Iterator[pa.Array]:
    return pieces(whole_texts(batch.column("text")), 8 * use.merge)


def word_counts(rows: DataFrame, use: Settings = Settings()) -> DataFrame:
    """(h, c): the hash of every word of the corpus, and its count in texts to learn from."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            at = 0
            for piece in _chunks(batch, use):
                words, code, text = _coded(piece)
                learned = ~held[at : at + len(piece)]
                at += len(piece)
                c = np.bincount(code, weights=learned[text], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(words).view(np.int64)), pa.array(c)], ["h", "c"])

    parts = rows.select("text", "held").mapInArrow(counted, "h bigint, c bigint")
    return parts.groupBy("h").agg(F.sum("c").alias("c"))


def _grams(words: pa.Array, code: np.ndarray, text: np.ndarray, n: int):
    """Hashes of distinct words and the end, and ``two``, ``one``, word and text of all tokens, as places of them."""
    hashes = np.append(_hashes(words), contexts.END)
    return hashes, *contexts.turns(code, text, n, len(words))


def context_grams(rows: DataFrame, shared, use: Settings) -> DataFrame:
    """N-grams of texts to learn from as mail to the parts, counted in pieces of ``use.merge`` tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, ranks = shared.value
        for batch in batches:
            for piece in _chunks(batch, use):
                hashes, two, one, own, _ = _grams(*_coded(piece), len(piece))
                key = contexts.pair_of(contexts.context_of(hashes[two], hashes[one]), hashes[own])
                at, n = contexts.counted(key, np.ones(len(key), np.int64))
                part = dealer.part(hashes[one[at]], hashes[own[at]])
                yield contexts.dealt(part, [two[at], one[at], own[at], n], 0, ranks.packer(hashes))

    return rows.filter("not held").select("text").mapInArrow(counted, contexts.MAIL)


def _collected(df: DataFrame) -> dict[str, np.ndarray]:
    return {c: v.to_numpy() for c, v in zip(df.columns, df.toArrow().columns)}


@dataclass
class Model:
    """What scoring needs: words with their probabilities, restaurants of contexts, and totals."""

    words: DataFrame  # h, c, score
    parts: DataFrame  # mail: a state for each part
    split: DataFrame  # h, score: the weight of the parent in restaurants that lie in several parts
    shared: Broadcast  # Dealer, Ranks
    head: Head
    tokens: int
    distinct: int
    ends: int


def learn(docs: DataFrame, use: Settings = Settings()) -> Model:
    """Learn from the rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("text", held_out(use).alias("held"))
    words = stage(word_counts(rows, use), "words")
    ends = rows.filter("not held").count()
    seen = words.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    tokens, distinct = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)

    hot = _collected(words.filter(F.col("c") > use.split))  # at most one in ``use.split`` tokens
    hashes, often = hot["h"].view(np.uint64), hot["c"]
    if ends > use.split:
        hashes, often = np.append(hashes, contexts.END), np.append(often, ends)
    order = np.argsort(hashes)
    dealer = contexts.Dealer(1 + tokens // use.part, hashes[order], 1 + often[order] // use.split)
    often = words.orderBy(F.col("c").desc(), "h").limit(use.known)  # a fixed number of words
    ranks = contexts.Ranks(np.append(contexts.END, _collected(often.select("h"))["h"].view(np.uint64)))
    shared = spark.sparkContext.broadcast((dealer, ranks))
    grams = context_grams(rows, shared, use)
    end = int(contexts.END.view(np.int64))
    many = words.filter("c > 1").unionByName(spark.createDataFrame([(end, ends)] if ends > 1 else [], words.schema))
    alone = seen["once"] + (ends == 1)
    base = 1 / (seen["v"] + 2)  # words, the end, and one for every word never seen
    parts, by_key, once, weight = contexts.learned(grams, many, shared, base, alone, tokens, distinct, use)

    value = by_key.filter("word").select("h", "value")
    p = F.when(F.col("c") == 1, once).otherwise(F.coalesce("value", F.lit(0.0))) + F.lit(weight * base)
    counted = words.join(value, "h", "left").select("h", "c", F.log10(p).alias("score"))
    counted = stage(counted, "word-scores")
    split = by_key.filter("not word").select("h", F.log10("value").alias("score"))
    found = value.filter(F.col("h") == end).first()
    end_score = np.log10((found["value"] if found else once * (ends == 1)) + weight * base)
    known = _collected(counted.orderBy(F.col("c").desc(), "h").limit(use.known))  # as ranked before
    head = Head(np.append([0, ends], known["c"]), np.append([np.nan, end_score], known["score"]))
    contexts.removed(words)
    return Model(counted, parts, split, shared, head, int(tokens), int(distinct), int(ends))


SUMS = (
    "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, "
    "asked int, h bigint, n bigint"
)
WAVES = 2
RARE, WORD, SPLIT = range(3)  # what is asked for: a word's count, a word's score, the weight of a split restaurant


def score(docs: DataFrame, model: Model, use: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    shared, head = model.shared, spark.sparkContext.broadcast(model.head)
    end_count, smoothed = model.ends, model.tokens + model.distinct + 1
    buckets = max(1, shared.value[0].parts // 4)
    base_of = lambda c: np.log10((c + 1) / smoothed)

    def scored(batches: Iterator[pa.RecordBatch], wave: int) -> Iterator[pa.RecordBatch]:
        """N-grams as mail to the parts of a wave; in the first, texts with what is known here as mail to themselves."""
        dealer, ranks = shared.value
        for row, doc_id, piece in numbered_pieces(batches):
            words, code, text = _coded(piece)
            hashes, two, one, own, of = _grams(words, code, text, len(piece))
            rank = ranks.of(hashes)
            if not wave:
                data = own_words(row, doc_id, code, text, hashes[:-1], rank[:-1])
                yield contexts.mail([(-1 - int(row[0]), contexts.TEXTS, 0, 0.0, contexts.sealed(data))])
            part = dealer.part(hashes[one], hashes[own])
            now = np.flatnonzero(part % WAVES == wave)
            columns = [x[now] for x in (two, one, own, (row - row[0])[of])]
            yield contexts.dealt(part[now], columns, int(row[0]), ranks.packer(hashes, rank))

    def own_words(
        row: np.ndarray, doc_id: pa.Array, code: np.ndarray, text: np.ndarray, hashes: np.ndarray, rank: np.ndarray
    ) -> tuple:
        """Texts with counts and scores by the head, and their rare words."""
        n, counts = len(row), head.value.counts
        word_base = np.where(rank > 0, base_of(counts[rank]), 0.0)
        sums = lambda values: np.bincount(text, weights=values, minlength=n)
        known = sums((counts[rank] > 0)[code]).astype(np.int64) + (end_count > 0)
        rare = np.flatnonzero((rank == 0)[code])  # the rest is known to the table of words only
        pair, often = np.unique(text[rare].astype(np.int64) * len(hashes) + code[rare], return_counts=True)
        lines = dict(
            row=row, doc_id=doc_id.to_pylist(), n_tokens=np.bincount(text, minlength=n) + 1, n_known=known,
            base_score=sums(word_base[code]) + base_of(end_count),
        )
        return lines, (row[pair // max(1, len(hashes))], hashes[pair % max(1, len(hashes))], often)

    def numbered_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        for batch in batches:
            at = 0
            for piece in _chunks(batch, use):
                if n := len(piece):
                    yield batch.column("row").slice(at, n).to_numpy(), batch.column("doc_id").slice(at, n), piece
                    at += n

    def answered(part: int, got: dict) -> list[tuple]:
        if part < 0:
            return [(-1 - part, contexts.TEXTS, 0, 0.0, data) for _, data in got[contexts.TEXTS]]
        dealer, ranks = shared.value
        state = contexts.rested(got, dealer, ranks, buckets, use)
        known = ranks.places, head.value.probabilities[ranks.ranks]
        return contexts.scores(got, dealer, known, ranks.read, state)

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of the texts sent together: sums by row, and what is still to be added."""
        got = contexts.by_kind(table)
        src, [(_, data)] = key[0].as_py(), got[contexts.TEXTS]
        lines, (row, h, n) = contexts.unsealed(data)
        at, value = (np.concatenate(c) for c in zip(*(pickle.loads(x) for _, x in got[contexts.SUMS])))
        total = np.zeros(1 + lines["row"][-1] - src)
        np.add.at(total, at.astype(np.int64), value)
        lines["score"] = total[lines["row"] - src]
        out = [lines, dict(row=row, asked=np.full(len(row), RARE, np.int32), h=h.view(np.int64), n=n)]
        if contexts.REST in got:
            row, h, split = (np.concatenate(c) for c in zip(*(pickle.loads(x) for _, x in got[contexts.REST])))
            (row, h, split), n = np.unique(np.stack([row, h, split.astype(np.uint64)]), axis=1, return_counts=True)
            out.append(dict(row=row.astype(np.int64) + src, asked=np.where(split, SPLIT, WORD), h=h.view(np.int64), n=n))
        return pa.concat_tables(
            pa.table([pa.array(x[f.name], f.type) if f.name in x else pa.nulls(len(x["row"]), f.type) for f in SCHEMA], schema=SCHEMA)
            for x in out
        )

    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    answers = []
    for wave in range(WAVES):  # so that the disk holds the n-grams of some of the parts
        grams = numbered.mapInArrow(lambda batches, w=wave: scored(batches, w), contexts.MAIL)
        mail = grams.unionByName(model.parts.filter(F.col("dest") % WAVES == wave))
        answers.append(stage(contexts.posted(mail, answered), "answers"))
        del grams, mail
        contexts.let_go(spark)
    sums = stage(reduce(DataFrame.unionByName, answers).groupBy("dest").applyInArrow(summed, SUMS), "sums")
    contexts.removed(*answers)
    whole = sums.filter("asked is null")
    base = F.log10((F.col("c") + 1) / F.lit(float(smoothed)))
    more = lambda of, table, known, base_score, value: sums.filter(F.col("asked") == of).join(table, "h").select(
        "row", known.alias("more_known"), (F.col("n") * base_score).alias("more_base"), (F.col("n") * value).alias("more_score")
    )
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    n_known = F.when(F.col("c") > 0, F.col("n")).otherwise(none)
    scored_words = model.words.withColumnRenamed("score", "own")
    parts_of_row = [
        more(RARE, scored_words, n_known, base, zero),
        more(WORD, scored_words, none, zero, F.col("own")),
        more(SPLIT, model.split.withColumnRenamed("score", "own"), none, zero, F.col("own")),
    ]
    more = reduce(DataFrame.unionByName, parts_of_row).groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("more_known", "more_base", "more_score"))
    )
    plus = lambda c, by: F.col(c) + F.coalesce(F.col(by), F.lit(0))
    return whole.join(more, "row", "left").select(
        "doc_id", held_out(use).alias("held_out"), "n_tokens", plus("n_known", "more_known").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        plus("base_score", "more_base").alias("base_score"), plus("score", "more_score").alias("score"),
    )


TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
SCHEMA = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in SUMS.split(", ")])


def perplexity(scored: DataFrame) -> DataFrame:
    """Per fold: perplexity of the model and of the unigram base over all tokens."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(
        per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity")
    )

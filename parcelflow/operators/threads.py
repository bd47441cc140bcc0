"""Threads of tweets: who answers whom, followed to the tweet that began it, by pointer doubling.

A tweet names its replies, so every reply points up at the tweet it answers.  In each round a tweet that does not yet
point at the beginning takes over the pointer of the tweet it points at, and adds up the steps; chains of n tweets
take log n joins.  Pointers that go round in a circle never arrive: once a round ends no chain, only circles and
what hangs on them are left, and each circle is opened before its smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chat import conversation_text
from ..staging import stage
from .lookup import hot_keys, lookup_join
from .pairs import to_bool, to_id


def _by_size(c: str) -> Column:
    """Order of ids: shorter ones first, so that whole numbers come in their order."""
    return F.struct(F.char_length(c).alias("size"), F.col(c).alias("id"))


def reply_links(tweets: DataFrame) -> DataFrame:
    """(id, up): every known tweet and the one it answers, null if none is known.

    Several response ids are separated by commas.  Of several tweets that name a reply the smallest id counts; a
    tweet that names itself, or one that is not there, is left as it is.
    """
    ids = tweets.select(to_id(F.col("tweet_id")).alias("id")).filter("id IS NOT NULL").distinct()
    named = tweets.select(
        to_id(F.col("tweet_id")).alias("up"), F.explode(F.split("response_tweet_id", ",")).alias("named")
    )
    named = named.select(to_id(F.col("named")).alias("id"), "up").filter("id IS NOT NULL AND up IS NOT NULL AND id != up")
    ups = named.groupBy("id").agg(F.min(_by_size("up"))["id"].alias("up"))
    return ids.join(ups, "id", "left")


def _jump(moving: DataFrame, links: DataFrame) -> DataFrame:
    """Pointers of ``moving`` after taking over those of the tweets they point at."""
    over = links.select(
        F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("least").alias("its"),
        F.col("done").alias("ends"),
    )
    met = lookup_join(moving.drop("done"), over, "up", hot=hot_keys(moving, "up"))
    least = F.when(_by_size("its") < _by_size("least"), F.col("its")).otherwise(F.col("least"))
    return met.select(
        "id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), least.alias("least"),
        F.col("ends").alias("done"),
    )


def _followed(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (id, up, steps, least, done) that arrived at a beginning, and those that never will."""
    arrived = [links.filter("done")]
    moving = links.filter("not done")
    left = moving.count()
    span, round_ends = 1, True
    while left:
        # Circles need a span as long as they are, chains end before.
        if not round_ends and span > left:
            break
        links = stage(_jump(moving, links).unionByName(links.filter("done")), "pointers")
        moving = links.filter("not done")
        span *= 2
        now = moving.count()
        round_ends, left = round_ends and now < left, now
    if left:
        return links.filter("done"), moving
    return (links if span > 1 else arrived[0]), moving


def threads(tweets: DataFrame) -> DataFrame:
    """(tweet_id, thread, turn): the id that began the thread of each tweet, and the steps from there.

    Rows without an id belong to no thread and are left out; a repeated id is one tweet.  In a circle the smallest
    id begins the thread.
    """
    known = stage(reply_links(tweets), "links")
    whole = known.join(known.select(F.col("id").alias("up"), F.lit(True).alias("there")), "up", "left")
    up = F.when(F.col("there"), F.col("up"))
    links = whole.select(
        "id", F.coalesce(up, F.col("id")).alias("up"), up.isNotNull().cast("bigint").alias("steps"),
        F.col("id").alias("least"), up.isNull().alias("done"),
    )
    links = stage(links, "pointers")
    found, circling = _followed(links)
    circling = stage(circling, "circling")
    if not circling.isEmpty():
        # After so many steps every pointer is on a circle, and every tweet of a circle is pointed at.
        heads = circling.select("up").distinct().withColumnRenamed("up", "id").join(circling, "id")
        heads = heads.filter(F.col("least") == F.col("id")).select("id", F.lit(True).alias("head"))
        again = links.join(circling.select("id"), "id", "left_semi").join(heads, "id", "left")
        head = F.coalesce("head", F.lit(False))
        again = again.select(
            "id", F.when(head, F.col("id")).otherwise(F.col("up")).alias("up"),
            F.when(head, F.lit(0)).otherwise(F.col("steps")).cast("bigint").alias("steps"), "least", head.alias("done"),
        )
        found = found.unionByName(_followed(stage(again, "opened"))[0])
    return found.select(F.col("id").alias("tweet_id"), F.col("up").alias("thread"), F.col("steps").alias("turn"))


def thread_texts(tweets: DataFrame, placed: DataFrame) -> DataFrame:
    """(thread, tweets, text): the training text of each thread, in the order of turns, then of ids."""
    own = tweets.select(
        to_id(F.col("tweet_id")).alias("tweet_id"),
        F.when(to_bool(F.col("inbound")), "user").otherwise("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("tweet_id IS NOT NULL")
    own = own.groupBy("tweet_id").agg(F.min(F.struct("role", "text")).alias("said")).select("tweet_id", "said.*")
    turn = F.struct(F.col("turn"), F.char_length("tweet_id").alias("size"), F.col("tweet_id"))
    turns = F.collect_list(F.struct(turn.alias("turn"), "role", "text"))
    rows = placed.join(own, "tweet_id").groupBy("thread").agg(F.count("*").alias("tweets"), turns.alias("turns"))
    return rows.select("thread", "tweets", conversation_text(F.col("turns")).alias("text"))

"""Trie of conversations: every distinct beginning of a conversation is a node, counted by ROLLUP.

The turns of a conversation become blocks of positional columns ``t1 .. t8`` (an id per role and text).  One ROLLUP
over these columns aggregates all beginnings that end in a block; ``grouping_id`` tells how many columns a row
keeps.  Longer conversations go on in further blocks, which are grouped by the node that the block before ended in.
A node is known by its depth and by a sum (exclusive or) of hashes of its turns and their places, 128 bits, so it is
found for all blocks at once and blocks need not wait for each other.

Sums over subtrees need no walk either: a node is credited to its smallest member, and the nodes of a conversation
are a run from some depth to its end.  What lies under a node is what its members hold at or below its depth, which
is a second ROLLUP over sums from the end of each conversation.

One conversation may hold a third of all turns and one node a third of all conversations: turns are placed by
ranges, running sums are taken in spans of blocks, rows of a conversation meet in spans, parents with very many
children are sent to all tasks (fewer than ``HOT_PARENTS`` can have that many), and the ids that end in a node are
joined to text in runs.

Null roles and texts are empty ones, a null turn number comes first, equal turn numbers are ordered by role and by
the MD5 of the text, repeated turns stay.  Turns without a conversation are left out.  Texts of any length are
hashed whole.  Other columns do not matter, whatever their names.  An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.staging import stage

from .common import maybe_broadcast
from .places import places

#: Positional columns of a block.
WIDE = 8
#: Blocks that a running sum handles at a time, and rows of a conversation that meet under one key.
SPAN = 4096
#: A parent with more than one of so many nodes as children is sent to all tasks.
HOT_PARENTS = 1000
#: Conversation ids joined to one text at a time.
IDS_AT_ONCE = 10_000
TURNS = [f"t{j}" for j in range(1, WIDE + 1)]
SIZES = [f"n{j}" for j in range(1, WIDE + 1)]
NODE = ["p1", "p2"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_id, n_bytes, size): narrow rows of turns, placed from 0 in their conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("text_md5"),
        F.unhex(F.md5(marked)).alias("turn_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    placed = places(rows, ["conv_id"], ["turn", "role", "text_md5"])
    return stage(placed.select("conv_id", "place", "turn_id", "n_bytes", "size"), "turns")


def branched(turns: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on others: the first ``shared`` turns of conversation ``base``, then their own later ones.

    ``shared`` is at most ``most``.  Returns (conv_id, n_turns) and (conv_id, place, turn_id, n_bytes).
    """
    sizes = stage(turns.filter("place = 0").select("conv_id", "size"), "sizes")
    wanted = sizes.select("conv_id", "size", base.alias("base"), shared.cast("bigint").alias("shared"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    taken = F.least("shared", F.coalesce("base_size", F.lit(0)))
    whole = stage(
        wanted.join(bases, "base", "left").select(
            "conv_id", "size", "base", "shared", taken.alias("taken"),
            (taken + F.greatest(F.col("size") - F.col("shared"), F.lit(0))).alias("n_turns"),
        ),
        "rebuilt",
    )
    first = turns.filter(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "turn_id", "n_bytes")
    start = whole.select("conv_id", "base", "taken").join(first, "base").filter("place < taken")
    spans = whole.select("conv_id", "shared", "taken", _spans("size").alias("span"))
    own = turns.withColumn("span", _span("place")).join(spans, ["conv_id", "span"]).filter("place >= shared")
    own = own.withColumn("place", F.expr("taken + place - shared"))
    names = ["conv_id", "place", "turn_id", "n_bytes"]
    return whole.select("conv_id", "n_turns"), start.select(names).unionByName(own.select(names))


def _span(place: str) -> Column:
    return F.expr(f"{place} div {SPAN}")


def _spans(size: str) -> Column:
    """A row for every span of a conversation, one at least."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest({size} - 1, 0) div {SPAN}")))


def _marks(place: Column, turn: Column) -> list[Column]:
    """Two hashes of a turn at its place, 0 where there is none."""
    return [F.when(turn.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), place, turn)) for seed in (1, 2)]


def _running(rows: DataFrame, at: str, sums: dict[str, Column], fold, back: bool = False) -> DataFrame:
    """Adds for each row what ``fold`` makes of the rows of its conversation before it (``back``: from it on).

    Spans are folded first, so that no task walks a whole conversation.
    """
    span = F.expr(f"{at} div {SPAN}")
    rows = rows.withColumn("span", span)
    order = (lambda c: F.desc(c)) if back else F.asc
    totals = rows.groupBy("conv_id", "span").agg(*[fold(c).alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy(order("span")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "span", *[fold(name).over(earlier).alias(f"{name}_far") for name in sums])
    totals = totals.filter(" OR ".join(f"{name}_far IS NOT NULL" for name in sums))
    near = Window.partitionBy("conv_id", "span").orderBy(order(at))
    near = near.rowsBetween(Window.unboundedPreceding, 0 if back else -1)
    rows = rows.withColumns({f"{name}_near": fold(c).over(near) for name, c in sums.items()})
    met = rows.join(totals, ["conv_id", "span"], "left")
    zero = F.lit(0).cast("bigint")
    for name in sums:
        far, by = F.coalesce(f"{name}_far", zero), F.coalesce(f"{name}_near", zero)
        met = met.withColumn(name, (far + by) if back else far.bitwiseXOR(by))
    return met.drop("span", *[f"{name}_{x}" for name in sums for x in ("far", "near")])


def block_rows(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Blocks (conv_id, block, t1.., n1.., p1, p2): turns in columns, and the node in which the block before ends.

    Every conversation has a first block, empty if it has no turn.
    """
    slot = F.col("place") % WIDE
    empty = convs.filter("n_turns = 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("turn_id"),
        F.lit(None).cast("bigint").alias("n_bytes"),
    )
    blocks = (
        turns.unionByName(empty).groupBy("conv_id", F.expr(f"place div {WIDE}").alias("block"))
        .agg(
            *[F.max(F.when(slot == j, F.col("turn_id"))).alias(t) for j, t in enumerate(TURNS)],
            *[F.max(F.when(slot == j, F.col("n_bytes"))).alias(n) for j, n in enumerate(SIZES)],
        )
    )
    own = _path_marks(WIDE)
    return stage(_running(blocks, "block", dict(zip(NODE, own)), F.bit_xor), "blocks")


def _path_marks(upto: int) -> list[Column]:
    """What the first ``upto`` turns of a block add to the hashes of its node."""
    marks = [_marks(F.col("block") * WIDE + j, F.col(TURNS[j])) for j in range(upto)]
    out = []
    for side in zip(*marks):
        whole = side[0]
        for m in side[1:]:
            whole = whole.bitwiseXOR(m)
        out.append(whole)
    return out


def _rolled(blocks: DataFrame, **sums: Column) -> DataFrame:
    """ROLLUP of blocks over their turns: a row per node, with the number of columns kept as ``kept``."""
    keys = ["block", *NODE]
    plain = blocks.select(*keys, *TURNS, "conv_id", *SIZES, *[c.alias(name) for name, c in sums.items()])
    named = ", ".join(f"sum({name}) AS {name}" for name in sums)
    sizes = ", ".join(f"max({n}) AS {n}" for n in SIZES)
    rolled = plain.sparkSession.sql(
        f"""SELECT {', '.join(keys)}, {', '.join(TURNS)}, {WIDE} - bit_count(grouping_id()) AS kept,
                   count(*) AS n_convs, min(conv_id) AS conv_id, {named or sizes}
            FROM {{rows}} GROUP BY {', '.join(keys)}, ROLLUP({', '.join(TURNS)})""",
        rows=plain,
    )
    # A beginning that stops before its last column is no node of its own; neither is a later block without turns.
    there = F.when(F.col("kept") == 0, F.col("block") == 0)
    for j, t in enumerate(TURNS, 1):
        there = there.when(F.col("kept") == j, F.col(t).isNotNull())
    return rolled.filter(there).withColumn("depth", F.col("block") * WIDE + F.col("kept"))


def _at_kept(names: list[str]) -> Column:
    """The column of the last turn that a row of the ROLLUP keeps."""
    out = F.lit(0).cast("bigint")
    for j, n in enumerate(names, 1):
        out = F.when(F.col("kept") == j, F.col(n)).otherwise(out)
    return out


def node_rows(blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, n_convs, saved, parent_conv_id, n_children): nodes without sums over subtrees."""
    # Columns that were rolled up are null and add nothing to the hashes of the path.
    own = [F.col(p).bitwiseXOR(m) for p, m in zip(NODE, _path_marks(WIDE))]
    last = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for j, t in enumerate(TURNS):
        here = _marks(F.col("block") * WIDE + j, F.col(t))
        last = tuple(F.when(F.col("kept") == j + 1, h).otherwise(x) for h, x in zip(here, last))
    nodes = stage(
        _rolled(blocks).select(
            "conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * _at_kept(SIZES)).alias("saved"),
            own[0].alias("p1"), own[1].alias("p2"),
            own[0].bitwiseXOR(last[0]).alias("up1"), own[1].bitwiseXOR(last[1]).alias("up2"),
        ),
        "nodes",
    )
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), "up1", "up2")
    children = children.agg(F.count("*").alias("n_children")).withColumnsRenamed({"up1": "p1", "up2": "p2"})
    grown = stage(
        nodes.join(children, ["depth", *NODE], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
        "family",
    )
    ups = ["depth", "up1", "up2"]
    parents = grown.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"),
        F.col("conv_id").alias("parent_conv_id"), "n_children",
    )
    many = nodes.count() / HOT_PARENTS
    hot = parents.filter(F.col("n_children") > many).drop("n_children").withColumnRenamed("parent_conv_id", "hot")
    rest = parents.filter(F.col("n_children") <= many).drop("n_children")
    met = grown.join(F.broadcast(hot), ups, "left")
    columns = [c for c in grown.columns if c not in ("up1", "up2")]
    direct = met.filter("hot IS NOT NULL OR depth = 0").select(*columns, F.col("hot").alias("parent_conv_id"))
    joined = met.filter("hot IS NULL AND depth > 0").join(rest, ups).select(*columns, "parent_conv_id")
    return stage(direct.unionByName(joined), "nodes")


def subtree_sums(blocks: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node, summed over its subtree."""
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("leaf"), "saved")
    below = stage(
        _running(own, "depth", {"leaves_on": F.col("leaf"), "saved_on": F.col("saved")}, F.sum, back=True), "below"
    )
    # A place of a block stands for the node that ends there, the place before the first for the root.
    ends = below.select(
        "conv_id", F.expr(f"greatest(depth - 1, 0) div {WIDE}").alias("block"),
        F.expr(f"CASE WHEN depth > 0 THEN (depth - 1) % {WIDE} + 1 ELSE 0 END").alias("kept"), "leaves_on", "saved_on",
    )
    wide = ends.groupBy("conv_id", "block").agg(
        *[
            F.max(F.when(F.col("kept") == j, F.col(f"{name}_on"))).alias(f"{name}{j}")
            for name in ("leaves", "saved") for j in range(WIDE + 1)
        ]
    )
    firsts = below.groupBy("conv_id").agg(
        F.max("leaves_on").alias("leaves_all"), F.max("saved_on").alias("saved_all")
    )
    # Above its first own node a member holds all that it holds; in spans, so that a long one is dealt out.
    firsts = convs.join(firsts, "conv_id").select(
        "conv_id", "leaves_all", "saved_all", _spans(f"(n_turns + {WIDE - 1}) div {WIDE}").alias("span")
    )
    met = blocks.drop(*SIZES).withColumn("span", _span("block"))
    met = met.join(wide, ["conv_id", "block"], "left").join(firsts, ["conv_id", "span"], "left")
    zero = F.lit(0).cast("bigint")
    sums = {
        f"{name}{j}": F.coalesce(f"{name}{j}", f"{name}_all", zero)
        for name in ("leaves", "saved") for j in range(WIDE + 1)
    }
    met = met.select("conv_id", "block", *NODE, *TURNS, *[c.alias(name) for name, c in sums.items()])
    met = met.withColumns({n: zero for n in SIZES})
    rolled = _rolled(met, **{name: F.col(name) for name in sums})

    def at(name: str) -> Column:
        out = F.col(f"{name}0")
        for j in range(1, WIDE + 1):
            out = F.when(F.col("kept") == j, F.col(f"{name}{j}")).otherwise(out)
        return out

    return rolled.select("conv_id", "depth", at("leaves").alias("n_leaves"), at("saved").alias("saved_tokens"))


def ends(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes in which conversations end."""
    here = [F.col(p).bitwiseXOR(m) for p, m in zip(NODE, _path_marks(WIDE))]
    turned = F.size(F.filter(F.array(*TURNS), lambda t: t.isNotNull()))
    # The last block of a conversation is the one that is not full, or the one after which none follows.
    last = blocks.select("conv_id", "block", here[0].alias("p1"), here[1].alias("p2"),
                         (F.col("block") * WIDE + turned).alias("depth"))
    lengths = convs.select("conv_id", F.col("n_turns").alias("depth"))
    key = ["depth", *NODE]
    listed = places(stage(last.join(lengths, ["conv_id", "depth"]).select("conv_id", *key), "ends"), key, ["conv_id"])
    runs = listed.groupBy(*key, "size", F.expr(f"place div {IDS_AT_ONCE}").alias("run")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    )
    runs = stage(runs, "runs")
    few = runs.filter(F.col("size") <= IDS_AT_ONCE).select(*key, F.sha2(F.col("ids").cast("binary"), 256).alias("sha"))
    many = runs.filter(F.col("size") > IDS_AT_ONCE).repartition(*key).sortWithinPartitions(*key, "run")
    long = many.select(*key, "ids").mapInArrow(_digests, "depth bigint, p1 bigint, p2 bigint, sha string")
    return few.unionByName(long).withColumnRenamed("sha", "ends_sha256")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the joined texts of each node, whose rows follow each other; only one text is held at a time."""
    at, state = None, None

    def row(key, state):
        depth, p1, p2 = key
        return pa.RecordBatch.from_pylist([{"depth": depth, "p1": p1, "p2": p2, "sha": state.hexdigest()}])

    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("depth", "p1", "p2")]
        for i, key in enumerate(zip(*names)):
            if key == at:
                state.update(b",")
            else:
                if at is not None:
                    yield row(at, state)
                at, state = key, hashlib.sha256()
            state.update(batch.column("ids")[i].as_py().encode())
    if at is not None:
        yield row(at, state)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of conversations (conv_id, n_turns) and their turns (conv_id, place, turn_id, n_bytes)."""
    blocks = block_rows(convs, turns)
    nodes = node_rows(blocks)
    sums = subtree_sums(blocks, convs, nodes)
    met = nodes.join(ends(convs, blocks), ["depth", *NODE], "left").join(sums, ["conv_id", "depth"])
    return met.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

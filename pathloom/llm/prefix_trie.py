"""Conversation prefix trie: which conversations begin alike, how deep, and how many tokens that saves.

Turns get dense names. Blocks of 2, 4, 8 ... turns that begin at a multiple of their length are named in as many
rounds of joins: a block's name is that of the pair of its halves' names (prefix doubling). A prefix of d turns is
composed of the blocks of d's binary digits, largest first, so the names of at most log2(d) blocks tell it from all
other prefixes of d turns; prefixes with equal names are one node. Sums over subtrees are doubled too: what a node has
within 2 ** k turns below it is handed to its ancestor 2 ** k turns above.

No task sees a conversation or a node's members: turns are counted over ranges, blocks are keyed by (conversation,
place), and a row meets its name by a join in which names that more than one in MOST_HOT of the rows have, fewer than
MOST_HOT, are broadcast. The digests of members are hashed from sorted pieces of text, made range by range.

Defined results
* rows are ordered by turn (null first), then by role and text's digest; a null role or text is empty.
* repeated rows are turns of their own. Rows without a conv_id are left out. Empty table: empty result.
* columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm.quotes import numbered

#: Conversations of a family share their first turns; the number of those is below HEADS.
FAMILY, HEADS = 5, 9
#: Fewer names than this can each be that of more than the same fraction of the rows.
MOST_HOT = 1000
#: Prefixes that one row of a block is exploded to at once; ids of a piece of a member list.
AT_ONCE, PIECE = 4096, 10_000


def _turn_digest(role: Column, text: Column) -> Column:
    """A digest of both; the length of the role tells where it ends."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str) -> DataFrame:
    """``rows`` joined with one row of ``groups`` (which has its ``size``) each; rows of large groups aren't shuffled."""
    hot = groups.filter(F.col(size) * MOST_HOT > total)
    rare = groups.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rare, keys))


def named(rounds: shared.Rounds, rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` without ``keys``, with name: a dense number (from 0) for each distinct value of the keys."""
    groups = rounds.settle(rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_nth", F.monotonically_increasing_id()), "groups")
    part = F.shiftrightunsigned("_nth", 33)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = groups.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_nth").alias("_first"))
    base = counts.select("_part", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    dense = groups.join(F.broadcast(base), part == F.col("_part")).select(*keys, "_n", (F.col("_nth") - F.col("_first") + F.col("_before")).alias("name"))
    return with_groups(rows, dense, keys, total, "_n").drop(*keys, "_n")


def rebuilt(rounds: shared.Rounds, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, bytes) and conversations (conv_id, size) after every conversation has taken its
    first turns from the first conversation of its family."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = messages.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _turn_digest(empty("role"), empty("text")).alias("digest"), F.octet_length(empty("text")).cast("long").alias("bytes"),
    )
    plain = rounds.settle(plain, "plain")
    turns = rounds.settle(numbered(plain, ["conv_id", "turn", "digest"], "conv_id", "at").drop("turn"), "turns")
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("heads")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", heads, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    sizes = rounds.settle(sizes, "sizes")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("_b"))
    taken = sizes.join(bases, "base", "left").withColumn("taken", F.least("heads", F.coalesce("_b", F.lit(0)))).drop("_b")
    taken = rounds.settle(taken, "taken")
    total = turns.count()
    own = with_groups(turns, taken.select("conv_id", "n", "heads", "taken"), ["conv_id"], total, "n").filter(F.col("at") >= F.col("heads"))
    own = own.select("conv_id", (F.col("taken") + F.col("at") - F.col("heads")).alias("pos"), "digest", "bytes")
    # at most HEADS - 1 turns of a conversation, each for the conversations of one family
    first = turns.filter(F.col("at") < HEADS).withColumnRenamed("conv_id", "base").join(taken.select("conv_id", "base", "heads"), "base").filter(F.col("at") < F.col("heads"))
    out = rounds.settle(own.unionByName(first.select("conv_id", F.col("at").alias("pos"), "digest", "bytes")), "rebuilt")
    return out, rounds.settle(taken.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("size")), "conversations")


def prefixes(rounds: shared.Rounds, turns: DataFrame, conversations: DataFrame, total: int, deepest: int) -> DataFrame:
    """conv_id, depth, size, names: every prefix of every conversation with the names of its blocks."""
    blocks = rounds.settle(named(rounds, turns.select("conv_id", F.col("pos").alias("block"), "digest"), ["digest"], total), "blocks-0")
    levels = [blocks]
    for k in range(1, max(1, deepest).bit_length()):
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(half(0).alias("_a"), half(1).alias("_b"))
        levels.append(rounds.settle(named(rounds, pairs.filter("_b is not null"), ["_a", "_b"], total >> k), f"blocks-{k}"))
    parts = None
    for k, level in enumerate(levels):
        # block 2 i of 2 ** k turns is in the prefixes whose digit k is set and whose higher digits are i
        low, high = (F.col("block") + 1) * (1 << k), F.least((F.col("block") + 2) * (1 << k) - 1, F.col("size"))
        held = level.filter("block % 2 = 0").join(conversations, "conv_id").filter(low <= high)
        steps = held.select("conv_id", "name", "size", high.alias("_high"), F.explode(F.sequence(low, high, F.lit(AT_ONCE).cast("long"))).alias("_low"))
        each = steps.select("conv_id", "size", F.lit(-k).alias("level"), "name", F.explode(F.sequence("_low", F.least(F.col("_low") + AT_ONCE - 1, F.col("_high")))).alias("depth"))
        parts = each if parts is None else parts.unionByName(each)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]).alias("names")  # as many as depth has digits set
    composed = parts.groupBy("conv_id", "depth", "size").agg(listed)
    roots = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), "size", F.array().cast("array<bigint>").alias("names"))
    return rounds.settle(composed.select("conv_id", "depth", "size", "names").unionByName(roots), "prefixes")


def ends_digest(rounds: shared.Rounds, members: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: the digest of the members (owner, depth, conv_id) of each node, joined in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"owner": [key[0]], "depth": [key[1]], "first": [ids[0]], "piece": [",".join(map(str, ids))]})

        for batch in batches:
            for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
                if ids and ((owner, depth) != key or len(ids) == PIECE):
                    yield piece()
                    ids = []
                key = (owner, depth)
                ids.append(conv)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for owner, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "piece")), strict=True):
                if key != (owner, depth):
                    if key is not None:
                        out.append((*key, running.hexdigest()))
                    key, running = (owner, depth), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(piece.encode())
            yield _digest_rows(out)
        if key is not None:
            yield _digest_rows([(*key, running.hexdigest())])

    order = ["owner", "depth", "conv_id"]
    ranged = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = rounds.settle(ranged.mapInArrow(pieces, "owner long, depth long, first long, piece string"), "pieces")
    return cut.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").select("owner", "depth", "piece").mapInArrow(digests, "owner long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["owner", "depth", "ends_sha256"])


def trie(messages: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rounds = shared.Rounds(messages.sparkSession, "trie")
    turns, conversations = rebuilt(rounds, messages)
    size = conversations.agg(F.max("size"), F.sum("size")).first()
    deepest, total = size[0] or 0, size[1] or 0
    every = prefixes(rounds, turns, conversations, total, deepest)

    groups = rounds.settle(every.groupBy("depth", "names").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")), "nodes")
    members = with_groups(every, groups, ["depth", "names"], total, "n_convs").select("conv_id", "depth", "size", "owner", "n_convs")
    members = rounds.settle(members, "members")
    rounds.drop("groups", "plain", "turns", "prefixes", "nodes", *(f"blocks-{k}" for k in range(64)))

    # the ancestor of node (owner, depth) that is s turns above is the node of its owner's prefix of depth - s turns
    own = members.filter("conv_id = owner").select("owner", "depth", "n_convs")
    above = members.select(F.col("conv_id").alias("owner"), "depth", F.col("owner").alias("above"))
    parents = own.join(above.withColumn("depth", F.col("depth") + 1), ["owner", "depth"], "left").withColumnRenamed("above", "parent")
    last = turns.select(F.col("conv_id").alias("owner"), (F.col("pos") + 1).alias("depth"), "bytes")
    parents = rounds.settle(parents.join(last, ["owner", "depth"], "left"), "parents")
    children = parents.filter("depth > 0").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = parents.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = rounds.settle(nodes, "facts")

    saved = F.coalesce((F.col("n_convs") - 1) * F.col("bytes"), F.lit(0)).alias("saved")
    sums = rounds.replace(nodes.select("owner", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), saved), "sums")
    step = 1
    while step <= deepest:
        sent = sums.filter(F.col("depth") >= step).withColumn("depth", F.col("depth") - step).join(above, ["owner", "depth"])
        got = sent.groupBy(F.col("above").alias("owner"), "depth").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        more = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        sums = rounds.replace(sums.join(got, ["owner", "depth"], "left").select("owner", "depth", more("leaves", "_l"), more("saved", "_s")), "sums")
        step *= 2

    ends = ends_digest(rounds, members.filter("depth = size"))
    out = nodes.join(sums, ["owner", "depth"]).join(ends, ["owner", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

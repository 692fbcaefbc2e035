"""Conversation prefix trie: nodes keyed by digests of prefixes, subtree sums by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import running
from ..scratch import Scratch

LANE = (1 << 32) - 1
CHUNK = 4096  # ids in one piece of a list that is hashed


def turn_rows(conversations: DataFrame, scratch: Scratch, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, i, h1, h2, chars): turns numbered from 0 within each conversation, with 128 bits of hash of (role, text).

    Order: turn, null first; equal turns by role and then by the MD5 of the text; rows that repeat wholly stay, one after
    another. Null role or text is empty. Rows without a conversation's id are no turns. Texts are read once and never move.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), F.length(text).cast("long").alias("chars"),
    )
    return running(turns, ["conv"], ["turn", "role", "tie"], scratch, sums={"i": F.lit(1)}, before=True).select("conv", "i", "h1", "h2", "chars")


def rebuilt(turns: DataFrame, scratch: Scratch, heads: int = 6, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation c begins with the first h turns of conversation c - c % every.

    h is the unsigned crc32 of the decimal c, modulo `heads`; c's own turns after its first h follow. turns: (conv, i, h1, h2,
    chars, last); conversations: (conv, size), those without turns too. `turns` as `turn_rows` returns them, written.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads)).cast("int")
    n = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    first = turns.where((F.col("conv") % every == 0) & (F.col("i") < heads - 1)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("i", "h1", "h2", "chars"))).alias("head"))  # heads - 1 at most
    convs = n.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % every}).join(first.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest("h", F.lit(1)))))
    convs = convs.withColumn("b", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("b", F.greatest("b", F.lit(0)))
    convs = scratch.save(convs.select("conv", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"), "head"))
    lent = convs.select("conv", "size", F.posexplode("head").alias("i", "t")).select("conv", F.col("i").cast("long").alias("i"), "t.h1", "t.h2", "t.chars", "size")
    own = turns.where(F.col("i") >= h).join(convs.select("conv", "h", "b", "size"), "conv").select("conv", (F.col("b") + F.col("i") - F.col("h")).alias("i"), "h1", "h2", "chars", "size")
    both = lent.unionAll(own)
    return both.select("conv", "i", "h1", "h2", "chars", (F.col("i") == F.col("size") - 1).alias("last")), convs.select("conv", "size")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in order; holds one state, whatever a node's length."""
    now, state = None, None
    for batch in batches:
        done = []
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (a, b) != now:
                if state:
                    done.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "sha"), d, strict=True)) for d in done])
    if state:
        yield pa.RecordBatch.from_pylist([{"a": now[0], "b": now[1], "sha": state.hexdigest()}])


def ends_digest(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, sha): for each node (a, b) the SHA-256 of its conversations' ids, ascending, comma-joined.

    Ids are numbered by ranges and joined into pieces of 4,096, so the one task that must hash a node's list from end to end
    reads a row for each piece, in order, and keeps only the hash's state.
    """
    placed = running(ends, ["a", "b"], ["conv"], scratch, sums={"n": F.lit(1)}, before=True)
    pieces = placed.groupBy("a", "b", F.floor(F.col("n") / CHUNK).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("text"))
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece").select("a", "b", "text").mapInArrow(_hashed, "a long, b long, sha string")


def _subtree_sums(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, leaves, saved) summed over each node's subtree, from nodes (a, b, pa, pb, depth, leaves, saved).

    Round k knows each node's 2^k-th ancestor and the sums over descendants nearer than 2^k. Every node hands its sums to that
    ancestor, once, and takes the ancestor's ancestor for the next round: as many rounds as the depth has bits.
    """
    state = scratch.save(nodes.select("a", "b", "pa", "pb", "leaves", "saved"))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(depth).bit_length()):
        given = state.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = state.where("pa is not null").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        met = state.join(given, ["a", "b"], "left").join(above, ["pa", "pb"], "left")
        met = met.select("a", "b", F.col("qa").alias("pa"), F.col("qb").alias("pb"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        nxt = scratch.save(met)
        scratch.drop(state)
        state = nxt
    return state.select("a", "b", "leaves", "saved")


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each distinct sequence of first turns, from the root without turns:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key_hi, key_lo).

    turns: (conv, i, h1, h2, chars, last), i from 0 without gaps; convs: every conversation with its size, once each.
    A prefix's digest is the sum of its turns' hashes at their places, in four lanes of 32 bits, so that it is a running
    sum: a conversation of any length is computed by ranges, and a node knows its parent's digest by taking its own turn
    away. Nodes are combined before they are shuffled, so a first turn of a third of all conversations is no hot group.
    conv_id: smallest member; ends_sha256: of the conversations that end at the node. Without conversations there is no
    root: the result is empty.
    """
    lanes = {}
    for n, seed in enumerate((3, 4)):
        x = F.xxhash64(F.lit(seed), "i", "h1", "h2")
        lanes |= {f"s{2 * n}": F.shiftrightunsigned(x, 32), f"s{2 * n + 1}": x.bitwiseAND(LANE)}
    held = turns.select("conv", "i", "chars", "last", *[c.alias(f"x{n}") for n, c in enumerate(lanes.values())])
    summed = running(held, ["conv"], ["i"], scratch, sums={f"s{n}": F.col(f"x{n}") for n in range(4)})

    def packed(x, y):
        return F.shiftleft(x.bitwiseAND(LANE), 32).bitwiseOR(y.bitwiseAND(LANE))

    s, p = [F.col(f"s{n}") for n in range(4)], [F.col(f"s{n}") - F.col(f"x{n}") for n in range(4)]
    places = scratch.save(summed.select("conv", (F.col("i") + 1).alias("depth"), "chars", "last", packed(s[0], s[1]).alias("a"), packed(s[2], s[3]).alias("b"), packed(p[0], p[1]).alias("pa"), packed(p[2], p[3]).alias("pb")))
    nodes = places.groupBy("a", "b").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0")
    none = F.lit(None).cast("long")
    nodes = nodes.select("a", "b", "conv", "depth", "pa", "pb", "n", "chars").unionAll(
        root.select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv", F.lit(0).cast("long"), none, none, "n", F.lit(0).cast("long"))
    )
    nodes = scratch.save(nodes)
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = scratch.save(nodes.join(kids, ["a", "b"], "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    sums = _subtree_sums(nodes.withColumns({"leaves": F.when(F.col("kids") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n") - 1) * F.col("chars")}), scratch)
    ends = places.where("last").select("a", "b", "conv").unionAll(convs.where("size = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, ["a", "b"]).join(ends_digest(ends, scratch), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", empty).alias("ends_sha256"), F.col("a").alias("key_hi"), F.col("b").alias("key_lo"),
    )


def conversation_trie(conversations: DataFrame, heads: int = 6, every: int = 100) -> DataFrame:
    """`prefix_trie` of conversations rebuilt by `rebuilt`. Empty in, empty out; very long texts count by their length and
    hash; columns beside the four named ones are not read."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.save(turn_rows(conversations, scratch))
    return prefix_trie(*rebuilt(turns, scratch, heads, every), scratch)

"""Prefix trie of conversations from vertical bitmaps.

Conversations are cut into shards of consecutive ids. The index of a shard maps a position
and a turn to the bitset of the shard's conversations with that turn at that position. A
depth-first walk intersects the parent's bitset with the postings of the next position: each
non-empty intersection is a child, its popcount the number of members, and the members that
end there are the shard's piece of the end list. Nodes of different shards are the same node
when their keys are equal: a key is the sum, modulo 2^128, of a digest of every turn with its
position, so it can be continued from any depth. Turns enter as SHA-256 digests; texts are
read once and never shuffled.

What a node sums over its subtree is summed over its members instead, so no level of the trie
waits for another. Every node belongs to its smallest member, and the nodes of one owner are
the lower end of its path. With ``shared`` the bytes of a conversation above its own nodes, a
node at depth d saves the sum over its members of max(shared - bytes of the first d - 1
turns, 0), and it has as many leaves as members that own one. A second walk adds these up.

A conversation of very many turns is cut into segments of ``SEGMENT`` positions; the walk of a
later segment starts from the keys that its conversations have reached. So a shard is bounded
in conversations and turns, whatever is frequent. End lists of a third of all ids are hashed
as a stream of the shards' pieces, which are in the order of the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import Stored, store
from tallyfield.llm.prefix import prefix_sums, range_parts
from tallyfield.operators.scan import ordered, running

#: Turns and conversations of a shard, and positions of a segment.
SHARD_TURNS = 10_000
SEGMENT = 1_024
#: Conversations of a family share its first member's opening of at most ``HEAD - 1`` turns.
FAMILY = 5
HEAD = 9

_ROOT = bytes(16)
_WRAP = 1 << 128
_NODES = (
    "shard bigint, key binary, parent binary, depth bigint, low bigint, n bigint, bytes bigint, path_bytes bigint, ends string"
)
_SUMS = "key binary, saved bigint, leaves bigint"


def head_length(conv_id: Column) -> Column:
    """Turns that a conversation takes over from the first member of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def _numbered(conversations: DataFrame) -> Stored:
    """``conv_id``, ``i`` (place by turn, null first), digest of role and text, and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.sha2(framed.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    scan = running(ordered(turns, ["conv_id"], ["turn", "digest"]), {"i": ("count", F.lit(1))})
    return store(scan.result().select("conv_id", F.coalesce("i", F.lit(0)).alias("i"), "digest", "bytes"), "turns")


def rebuilt(conversations: DataFrame, shard_turns: int = SHARD_TURNS, segment: int = SEGMENT) -> tuple[Stored, Stored]:
    """Conversations after each has taken over its family's opening, and their shards.

    Returns turns (``conv_id``, ``position``, ``digest``, ``bytes``, ``shard``, ``length``)
    and conversations (``conv_id``, ``length``, ``shard``), both stored.
    """
    turns = _numbered(conversations)
    own = turns.df
    sizes = store(own.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    first = sizes.df.select(F.col("conv_id").alias("_first"), F.col("n").alias("_n"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = head_length(F.col("conv_id"))
    taken = F.least(h, F.coalesce("_n", F.lit(0)))
    lengths = sizes.df.join(first, family == F.col("_first"), "left").select(
        "conv_id", taken.alias("taken"), (taken + F.greatest(F.col("n") - h, F.lit(0))).alias("length")
    )
    weighed = lengths.withColumn("weight", F.least("length", F.lit(segment)) + 1)
    ranged = range_parts(weighed, [F.col("conv_id")])
    shard = F.expr(f"(_end - weight) div {shard_turns}")
    convs = store(prefix_sums(ranged, [F.col("conv_id")], "weight").select("conv_id", "taken", "length", shard.alias("shard")), "convs")
    ranged.drop()

    # The opening of a family's first member goes to every other member that is there.
    others = F.array(*[F.try_add(F.col("conv_id"), F.lit(k)) for k in range(1 - FAMILY, FAMILY)])
    heads = (
        own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("i") < HEAD - 1))
        .select(F.col("conv_id").alias("_first"), F.explode(others).alias("conv_id"), F.col("i"), "digest", "bytes")
        .filter((family == F.col("_first")) & (F.col("i") < h))
        .select("conv_id", F.col("i").alias("_head"), F.lit(None).cast("long").alias("_tail"), "digest", "bytes")
    )
    tails = own.filter(F.col("i") >= h).select(
        "conv_id", F.lit(None).cast("long").alias("_head"), (F.col("i") - h).alias("_tail"), "digest", "bytes"
    )
    # The conversations are stored, so a conversation with very many turns can be split in this join.
    joined = heads.unionByName(tails).join(convs.df, "conv_id").select(
        "conv_id", F.coalesce("_head", F.col("_tail") + F.col("taken")).alias("position"), "digest", "bytes", "shard", "length"
    )
    placed = store(joined, "rebuilt")
    turns.drop()
    sizes.drop()
    return placed, convs


def _turn_value() -> list[Column]:
    """A turn's part of a key, as four numbers of 32 bits; the same as ``turn_value``."""
    mixed = F.sha2(F.concat(F.col("position").cast("string").cast("binary"), F.lit(b":"), F.col("digest")), 256)
    return [F.conv(F.substring(mixed, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"v{k}") for k in range(4)]


def turn_value(position: int, digest: bytes) -> int:
    return int.from_bytes(hashlib.sha256(b"%d:%b" % (position, digest)).digest()[:16], "big")


def _index_rows(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """Rows of all shards and segments: one per conversation and segment (``position`` null), one per turn.

    The former carry what the conversation has reached before the segment: the key as four
    sums and the bytes.
    """
    long = F.col("length") > segment
    seg = F.expr(f"position div {segment}")
    parts = (
        turns.filter(long)
        .select("conv_id", "shard", "length", seg.alias("seg"), "bytes", *_turn_value())
        .groupBy("conv_id", "shard", "length", "seg")
        .agg(F.sum("bytes").alias("bytes"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(4)])
    )
    # One row per segment, so a thousandth of the conversation's turns.
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    later = parts.select(
        "shard", (F.col("seg") + 1).alias("seg"), "conv_id", "length",
        F.sum("bytes").over(upto).alias("bytes"), *[F.sum(f"v{k}").over(upto).alias(f"v{k}") for k in range(4)],
    ).filter(F.col("seg") * segment < F.col("length"))
    zero = F.lit(0).cast("long")
    opening = convs.select(
        "shard", zero.alias("seg"), "conv_id", "length", zero.alias("bytes"), *[zero.alias(f"v{k}") for k in range(4)]
    )
    members = opening.unionByName(later).withColumns({"position": F.lit(None).cast("long"), "digest": F.lit(None).cast("binary")})
    rows = turns.select(
        "shard", seg.alias("seg"), "conv_id", "length", "bytes", *[zero.alias(f"v{k}") for k in range(4)], "position", "digest"
    )
    return members.unionByName(rows)


@dataclass
class Node:
    key: int
    parent: int | None
    depth: int
    bits: int
    ended: int
    bytes: int
    path_bytes: int


class Shard:
    """Vertical bitmaps of one segment of one shard."""

    def __init__(self, table: pa.Table, width: int):
        position = table.column("position").combine_chunks()
        members = table.filter(position.is_null()).sort_by("conv_id")
        turns = table.filter(position.is_valid())
        self.members = members
        self.shard = table.column("shard")[0].as_py()
        segment = table.column("seg")[0].as_py()
        self.first, self.last = segment * width, (segment + 1) * width
        self.ids = members.column("conv_id").to_numpy()
        ordinal = np.searchsorted(self.ids, turns.column("conv_id").to_numpy()).tolist()
        #: Bitset, digest value and bytes of every (position, turn); and each member's turn by position.
        self.postings: list[int] = []
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.turn_at: dict[int, dict[int, int]] = {}
        self.ended_at: dict[int, int] = {}
        known: dict[tuple[int, bytes], int] = {}
        columns = (turns.column(c).to_pylist() for c in ("position", "digest", "bytes"))
        for o, at, digest, size in zip(ordinal, *columns, strict=True):
            number = known.setdefault((at, digest), len(known))
            if number == len(self.postings):
                self.postings.append(0)
                self.values.append(turn_value(at, digest))
                self.sizes.append(size)
            self.postings[number] |= 1 << o
            self.turn_at.setdefault(at, {})[o] = number
        for o, length in enumerate(members.column("length").to_pylist()):
            self.ended_at[length] = self.ended_at.get(length, 0) | 1 << o

    def _starts(self) -> Iterator[Node]:
        """Where the walk begins: the root, or the nodes that the segment before has reached."""
        if not self.first:
            everyone = (1 << len(self.ids)) - 1
            yield Node(0, None, 0, everyone, self.ended_at.get(0, 0), 0, 0)
            return
        at: dict[int, list[int]] = {}
        columns = (self.members.column(c).to_pylist() for c in ("v0", "v1", "v2", "v3", "bytes"))
        for o, (a, b, c, d, size) in enumerate(zip(*columns, strict=True)):
            key = ((a << 96) + (b << 64) + (c << 32) + d) % _WRAP
            entry = at.setdefault(key, [0, size])
            entry[0] |= 1 << o
        for key, (bits, size) in at.items():
            yield Node(key, None, self.first, bits, 0, 0, size)

    def walk(self) -> Iterator[Node]:
        """All nodes of the segment, depth first; a node at its start belongs to the segment before."""
        stack = list(self._starts())
        while stack:
            node = stack.pop()
            if node.depth > self.first or not self.first:
                yield node
            if node.depth == self.last:
                continue
            turn_at = self.turn_at.get(node.depth, {})
            left = node.bits ^ node.ended
            while left:
                number = turn_at[(left & -left).bit_length() - 1]
                bits = left & self.postings[number]
                left ^= bits
                size, depth = self.sizes[number], node.depth + 1
                key = (node.key + self.values[number]) % _WRAP
                stack.append(Node(key, node.key, depth, bits, bits & self.ended_at.get(depth, 0), size, node.path_bytes + size))

    def ordinals(self, bits: int) -> np.ndarray:
        if bits & (bits - 1) == 0:
            return np.array([bits.bit_length() - 1] if bits else [], dtype=np.int64)
        raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), dtype=np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _binary(key: int | None) -> bytes | None:
    return None if key is None else key.to_bytes(16, "big")


def _shard_nodes(table: pa.Table, width: int) -> pa.Table:
    """Nodes of one shard with their popcounts, smallest members and end lists."""
    shard, rows = Shard(table, width), []
    for node in shard.walk():
        low = int(shard.ids[(node.bits & -node.bits).bit_length() - 1])
        ends = ",".join(map(str, shard.ids[shard.ordinals(node.ended)].tolist())) if node.ended else None
        rows.append((
            shard.shard, _binary(node.key), _binary(node.parent), node.depth, low, node.bits.bit_count(), node.bytes, node.path_bytes, ends,
        ))
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    types = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string()]
    names = ["shard", "key", "parent", "depth", "low", "n", "bytes", "path_bytes", "ends"]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _shard_sums(table: pa.Table, width: int) -> pa.Table:
    """Each node's part of the subtree sums from the members of one shard."""
    shard = Shard(table, width)
    shared, leaf = (shard.members.column(c).to_numpy() for c in ("shared", "leaf"))
    keys, saved, leaves = [], [], []
    for node in shard.walk():
        members = shard.ordinals(node.bits)
        keys.append(_binary(node.key))
        saved.append(int(np.maximum(shared[members] - (node.path_bytes - node.bytes), 0).sum()))
        leaves.append(int(leaf[members].sum()))
    return pa.table([pa.array(keys, pa.binary()), pa.array(saved, pa.int64()), pa.array(leaves, pa.int64())], names=["key", "saved", "leaves"])


def _end_digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each node's end list, streamed piece by piece in the order of the shards."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

        for batch in batches:
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        yield row()
                    now, digest = key, hashlib.sha256()
                digest.update(ends.encode())
        if now is not None:
            yield row()

    parts = max(2, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = pieces.repartition(parts, "key").sortWithinPartitions("key", "shard").select("key", "ends")
    return rows.mapInArrow(stream, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Turns are taken in the order of ``turn``, null first, equal ones by a digest of role and
    text, repeated rows repeatedly; null role or text counts as empty, texts of any length are
    taken whole. Rows without a conv_id belong to no conversation and are left out; other
    columns are ignored. A conversation that loses all its turns is a member of the root. An
    empty table has no root and gives no rows.
    """
    turns, convs = rebuilt(conversations, shard_turns, segment)
    index = store(_index_rows(turns.df, convs.df, segment), "bitmaps")
    by_shard = store(index.df.groupBy("shard", "seg").applyInArrow(lambda t: _shard_nodes(t, segment), _NODES), "shard-nodes")
    merged = store(
        by_shard.df.groupBy("key").agg(
            F.min("low").alias("conv_id"),
            F.sum("n").alias("n_convs"),
            *[F.first(c).alias(c) for c in ("parent", "depth", "bytes", "path_bytes")],
        ),
        "nodes",
    )
    children = merged.df.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = store(merged.df.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    owners = nodes.df.groupBy("conv_id").agg(
        F.min_by(F.col("path_bytes") - F.col("bytes"), "depth").alias("shared"),
        F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf"),
    )
    # A conversation that owns no node shares all its bytes.
    totals = turns.df.groupBy("conv_id").agg(F.sum("bytes").alias("total"))
    shares = convs.df.select("conv_id").join(owners, "conv_id", "left").join(totals, "conv_id", "left")
    shares = store(
        shares.select("conv_id", F.coalesce("shared", "total", F.lit(0)).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "shares"
    )
    members = index.df.filter("position is null").join(shares.df, "conv_id")
    rows = index.df.filter("position is not null").withColumns({"shared": F.lit(None).cast("long"), "leaf": F.lit(None).cast("long")})
    parts = members.unionByName(rows).groupBy("shard", "seg").applyInArrow(lambda t: _shard_sums(t, segment), _SUMS)
    sums = parts.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = _end_digests(by_shard.df.filter("ends is not null").select("key", "shard", "ends"))
    # Keys are unique on both sides, except that many nodes may have one parent; the nodes are stored, so that join can be split.
    parents = merged.df.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.df.join(parents, "parent", "left")
        .join(sums, "key", "left")
        .join(ends, "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        )
    )

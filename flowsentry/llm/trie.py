"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns (role and text); its members are the conversations
that begin with it.  Nobody holds the whole trie, nor all members of a node:

1. Conversations are cut, in order of their ids, into shards of at most ``SHARD_TURNS`` turns and
   ``SHARD_CONVERSATIONS`` conversations.  A shard indexes (position, turn) to a bitset of its
   conversations.  Depth first, the bitset of a node meets the postings of the next turn of its
   first remaining member: the intersection is a child, its population the child's members, its
   lowest bit the child's smallest member, and the members that stop there are its end list.
2. A node's name is a SHA-256 chain over its turns, so shards agree on it.  Members and ends are
   summed over shards, the smallest member is the least of theirs.  A node occurs once per
   shard at most, so the root and a first turn that a third of all conversations share are as
   many rows as there are shards.
3. Of the shards that hold a node, the one that holds its smallest member answers for it.  Each
   shard sums over its own subtrees the nodes that it answers for (leaves, saved tokens,
   children).  The smallest member of a node lies below all its ancestors in the same shard, so
   adding these sums over shards counts each node of a subtree once.
4. End lists stay pieces of at most ``PIECE`` ids in order, and are digested as a stream.

Only digests and sizes of turns are shuffled, no texts.  A conversation of more than
``SHARD_TURNS`` turns is a shard of its own and is walked as a stream, up and down, without a
bitmap; like any order by turn of one conversation that is one task's work, in bounded memory.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then by
digest (rows that repeat a turn are turns of their own); rows of a null conversation id belong
to no conversation and are left out; a conversation without turns ends at the root; an empty
table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

SHARD_TURNS = 1 << 16
SHARD_CONVERSATIONS = 1 << 12
PIECE = 256  # ids of a piece of an end list
ROOT = hashlib.sha256(b"").digest()

_NODES = "part int, shard long, place long, depth long, node binary, n long, ends long, first long, bytes long, ended array<long>"


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, kept apart by the role's length."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos from 0, digest, bytes) of every turn that has a conversation."""
    slim = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return slim.select("conv", (F.row_number().over(order) - 1).cast("long").alias("pos"), "digest", "bytes")


# ---------------------------------------------------------------- one shard


class Shard:
    """Conversations of one shard: ids in ascending order, and each one's turns."""

    def __init__(self, ids: list[int], digests: list[list[bytes]], sizes: list[list[int]]):
        self.ids, self.digests, self.sizes = ids, digests, sizes

    def nodes(self):
        """Rows of ``_NODES`` in preorder."""
        postings, stops = {}, {}
        for k, own in enumerate(self.digests):
            bit = 1 << k
            stops[len(own)] = stops.get(len(own), 0) | bit
            for pos, turn in enumerate(own):
                postings[pos, turn] = postings.get((pos, turn), 0) | bit
        shard, place, stack = self.ids[0], 0, [((1 << len(self.ids)) - 1, 0, ROOT, 0)]
        while stack:
            members, depth, name, size = stack.pop()
            low = (members & -members).bit_length() - 1
            ended = members & stops.get(depth, 0)
            yield (shard, place, depth, name, members.bit_count(), ended.bit_count(), self.ids[low], size, self._ids(ended))
            place += 1
            rest, children = members & ~ended, []
            while rest:
                first = (rest & -rest).bit_length() - 1
                turn = self.digests[first][depth]
                child = rest & postings[depth, turn]
                children.append((child, depth + 1, hashlib.sha256(name + turn).digest(), self.sizes[first][depth]))
                rest &= ~child
            stack += reversed(children)

    def _ids(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out


def _table(rows: list) -> pa.RecordBatch:
    columns = [[TaskContext.get().partitionId()] * len(rows), *zip(*rows)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["part", "shard", "place", "depth", "node", "n", "ends", "first", "bytes", "ended"])


def shard_nodes(rows: DataFrame, parts: int) -> DataFrame:
    """Nodes of all shards; ``rows`` is (conv, pos, digest, bytes) with one row of pos -1 per conversation."""
    ordered = rows.repartitionByRange(parts, "conv").sortWithinPartitions("conv", "pos").select("conv", "digest", "bytes")

    def run(batches):
        shard, out, turns = Shard([], [], []), [], 0
        long = None  # (id, depth, name) of a conversation that is walked as a stream

        def closed():
            out.extend(shard.nodes())
            shard.ids, shard.digests, shard.sizes = [], [], []

        def end_of_long():
            conv, depth, name, size = long
            out.append((conv, depth, depth, name, 1, 1, conv, size, [conv]))

        for batch in batches:
            for conv, digest, size in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None:  # a conversation begins
                    if long:
                        end_of_long()
                        long = None
                    if len(shard.ids) >= SHARD_CONVERSATIONS or turns >= SHARD_TURNS:
                        closed()
                        turns = 0
                    shard.ids.append(conv)
                    shard.digests.append([])
                    shard.sizes.append([])
                elif long:
                    out.append((conv, long[1], long[1], long[2], 1, 0, conv, long[3], []))
                    long = (conv, long[1] + 1, hashlib.sha256(long[2] + digest).digest(), size)
                else:
                    shard.digests[-1].append(digest)
                    shard.sizes[-1].append(size)
                    turns += 1
                    if len(shard.digests[-1]) > SHARD_TURNS:  # too long for a bitmap: a shard of its own
                        own, sizes = shard.digests.pop(), shard.sizes.pop()
                        shard.ids.pop()
                        if shard.ids:
                            closed()
                        turns, long = 0, (conv, 0, ROOT, 0)
                        for d, s in zip(own, sizes):
                            out.append((conv, long[1], long[1], long[2], 1, 0, conv, long[3], []))
                            long = (conv, long[1] + 1, hashlib.sha256(long[2] + d).digest(), s)
                while len(out) >= 10_000:
                    yield _table(out[:10_000])
                    del out[:10_000]
        if long:
            end_of_long()
        if shard.ids:
            closed()
        for k in range(0, len(out), 10_000):
            yield _table(out[k:k + 10_000])

    return ordered.mapInArrow(run, _NODES)


# ---------------------------------------------------------------- all shards


_SUMS = "node binary, children long, leaves long, saved long, depth long, first long, n long, parent long"


def subtree_sums(nodes: DataFrame, parts: int) -> DataFrame:
    """Each shard's part of the sums of ``_SUMS``; ``nodes`` is (part, shard, place, depth, node, bytes, first, n, leaf, mine).

    Rows come from the last place of a shard to its first, so children stand before their
    parent: a stack of finished subtrees holds (depth, leaves, saved, children, owned rows that wait
    for their parent's smallest member).
    """
    ordered = nodes.repartitionById(parts, "part").sortWithinPartitions("shard", F.desc("place")) \
        .select("shard", "depth", "node", "bytes", "first", "n", "leaf", "mine")

    def run(batches):
        stack, out, now = [], [], None
        for batch in batches:
            for shard, depth, node, size, first, n, leaf, mine in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    stack, now = [], shard
                children = leaves = saved = 0
                while stack and stack[-1][0] == depth + 1:
                    _, more, tokens, row, own = stack.pop()
                    leaves += more
                    saved += tokens
                    children += own
                    row[-1] = first if own else None
                    out.append(row)
                if mine:
                    leaves += leaf
                    saved += (n - 1) * size
                row = [node, children, leaves, saved, depth if mine else None, first if mine else None, n if mine else None, None]
                if depth:
                    stack.append((depth, leaves, saved, row, int(mine)))
                else:
                    out.append(row)
            yield _sums(out)
            out = []

    return ordered.mapInArrow(run, _SUMS)


def _sums(rows: list) -> pa.RecordBatch:
    kinds = [pa.binary(), *[pa.int64()] * 7]
    columns = zip(*rows) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["node", "children", "leaves", "saved", "depth", "first", "n", "parent"])


class Trie:
    """``nodes``: node, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.

    ``ends``: node, piece (its first id), ids: the end lists in pieces of at most ``PIECE`` ids.
    """

    def __init__(self, nodes: DataFrame, ends: DataFrame):
        self.nodes, self.ends = nodes, ends

    def end_digests(self) -> DataFrame:
        """(node, ends_sha256): digest of the ascending, comma-joined ids of each node's end list, as a stream."""
        parts = int(self.ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = self.ends.repartition(parts, "node").sortWithinPartitions("node", "piece").select("node", "ids")

        def run(batches):
            now, state = None, None
            for batch in batches:
                done = []
                for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = ",".join(map(str, ids)).encode()
                    if node != now:
                        if state:
                            done.append((now, state.hexdigest()))
                        now, state = node, hashlib.sha256(text)
                    else:
                        state.update(b"," + text)
                yield digests(done)
            if state:
                yield digests([(now, state.hexdigest())])

        def digests(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                              names=["node", "ends_sha256"])

        return pieces.mapInArrow(run, "node binary, ends_sha256 string")

    def with_turns(self, rows: DataFrame, conv_col: str, pos_col: str, *kept: str) -> DataFrame:
        """Nodes with the ``kept`` columns (such as role and text) of their last turn, from numbered turns."""
        last = rows.select(F.col(conv_col).alias("conv_id"), (F.col(pos_col) + 1).alias("depth"), *kept)
        return self.nodes.join(last, ["conv_id", "depth"], "left")


def build(spark: SparkSession, rows: DataFrame, convs: DataFrame) -> Trie:
    """The trie of numbered turns ``rows`` (conv, pos, digest, bytes; see ``turns``) of the conversations ``convs`` (conv)."""
    ws = Workspace(spark, "trie")
    begin = convs.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = ws.save(shard_nodes(rows.select("conv", "pos", "digest", "bytes").unionByName(begin), parts), "shards")
    whole = local.groupBy("node").agg(F.sum("n").alias("all"), F.sum("ends").alias("stopped"), F.min("first").alias("least"))
    known = local.select("node", "part", "shard", "place", "depth", "bytes", "first").join(whole, "node").select(
        "part", "shard", "place", "depth", "node", "bytes", F.col("least").alias("first"), F.col("all").alias("n"),
        (F.col("all") == F.col("stopped")).cast("int").alias("leaf"), (F.col("first") == F.col("least")).alias("mine"))
    sums = subtree_sums(known, parts).groupBy("node").agg(
        F.max("first").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ended") - 1) / PIECE).cast("int")),
                      lambda k: F.slice("ended", k * PIECE + 1, PIECE))
    ends = local.filter(F.size("ended") > 0).select("node", F.explode(cut).alias("ids")).select("node", F.col("ids")[0].alias("piece"), "ids")
    return Trie(sums, ends)

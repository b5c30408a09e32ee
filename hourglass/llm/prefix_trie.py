"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards of at most ``SHARD`` neighbouring ids and
their turns to bands of ``BAND`` positions.  Within a shard and band every
(position, turn) is indexed to the bitset of the conversations that have this
turn there.  Depth-first from the bitset of a node, the intersections with the
postings of the next position are its children; their popcounts, members and
the conversations that end there are the shard's share of the node.  A node
has the same key in every shard, so the shares are then added up.

Keys: below the start of its band a node's key is a running digest of the
turns; at a band's border it is the XOR of two 64-bit hashes of all (position,
turn) so far, which Spark sums in any grouping.  A band can therefore be
walked without the bands before it, and a long conversation is spread over
tasks.

Subtree sums need no pass per level.  A node belongs to its smallest member,
which then owns all deeper nodes on its own path too.  So the sum over a
subtree is what its top's owner owns from this depth on, plus all that the
other members own.

Scale: texts are hashed in the scan and not shuffled.  Turns are ordered by a
range partitioning that also splits rows equal in everything, numbered there,
and positions are carried over chunks.  A group of copies, a first turn that a
third of all conversations share or a conversation with a third of all rows is
one partial row per shard, or one per band.  End lists travel as one row per
shard.  Their digest is read in id order with constant memory, as SHA-256 has
no parallel form.

Defined cases: a null conversation id belongs to no conversation, such rows
are left out; null roles and texts count as empty; null turn numbers come
first; turns with the same number are ordered by the digest of role and text;
repeated rows are repeated turns; an empty table has no nodes, not even a
root.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourglass.session import materialize

SHARD = 2048  # conversations of a shard: bits of a bitset
BAND = 64  # positions that are walked together
CHUNK_ROWS = 1024
NODES = "shard long, depth long, key binary, parent binary, n_bytes long, members array<long>, ends array<long>"
NODES_ARROW = pa.schema([("shard", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()),
                         ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


# ---------------------------------------------------------------- turns in order


def number_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, conversations)``: rows (conv_id, pos from 0, item, n_bytes), conversations (conv_id, n_turns).

    ``item`` is the SHA-256 of role and text, ``n_bytes`` the text's UTF-8 length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    item = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "item", "tie"]
    rows = (turns.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), item.alias("item"),
                    F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("tie"))
            .repartitionByRange(*order).sortWithinPartitions(*order))
    rows = materialize(rows.select("conv_id", "item", "n_bytes", F.monotonically_increasing_id().alias("seq")), "trie-turns")
    rows = rows.withColumn("chunk", F.floor(F.col("seq") / CHUNK_ROWS))
    chunks = materialize(rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n")), "trie-chunks")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("seq")) - 1
    placed = rows.withColumn("place", place).join(offsets, ["conv_id", "chunk"])
    return (placed.select("conv_id", (F.col("before") + F.col("place")).alias("pos"), "item", "n_bytes"),
            chunks.groupBy("conv_id").agg(F.sum("n").alias("n_turns")))


def splice_heads(rows: DataFrame, conversations: DataFrame, head: Column, base: Column, reach: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Replace the first ``head`` turns of every conversation by those of conversation ``base``, in the shape of ``number_turns``.

    ``head`` (at most ``most``) and ``base`` are functions of ``conv_id``,
    ``base`` at most ``reach`` away.  A shorter base gives all its turns, an
    absent one none; the conversation goes on with its own turns after its
    first ``head``.
    """
    plan = conversations.select("conv_id", "n_turns", head.cast("long").alias("head"), base.cast("long").alias("base"))
    known = conversations.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    plan = plan.join(known, "base", "left").withColumn("given", F.least("head", F.coalesce("n_base", F.lit(0))))
    plan = materialize(plan.select("conv_id", "head", "base", "given", (F.col("given") + F.greatest(F.col("n_turns") - F.col("head"), F.lit(0))).alias("n_turns")), "trie-plan")
    own = (rows.join(plan.select("conv_id", "head", "given"), "conv_id").where("pos >= head")
           .select("conv_id", (F.col("given") + F.col("pos") - F.col("head")).alias("pos"), "item", "n_bytes"))
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("step")
    near = rows.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "item", "n_bytes", step)
    near = near.withColumn("conv_id", F.expr("try_add(base, cast(step as bigint))"))
    lent = near.join(plan.select("conv_id", "base", "head"), ["conv_id", "base"]).where("pos < head").select("conv_id", "pos", "item", "n_bytes")
    return own.unionByName(lent), plan.select("conv_id", "n_turns")


# ---------------------------------------------------------------- one shard and band


def _ids(bits: int, ids: list[int]) -> list[int]:
    """The ids of the set bits, in order."""
    out = []
    while bits:
        low = bits & -bits
        out.append(ids[low.bit_length() - 1])
        bits ^= low
    return out


def walk(ids: list[int], lengths: list[int], starts: list[bytes], borders: list[bytes], turns: list[list[bytes]], sizes: list[list[int]],
         base: int, width: int = BAND) -> Iterator[tuple[int, bytes, bytes | None, int, list[int], list[int]]]:
    """Nodes of one shard and band, depth first: (depth, key, parent key, bytes of the last text, members, members that end there).

    ``ids`` ascend; ``turns`` are each conversation's turns from position
    ``base`` on, at most ``width``; ``starts`` and ``borders`` are the keys at
    the band's two ends.  The node at ``base`` itself is only given for band 0.
    """
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    tops: dict[bytes, int] = {}
    for i, said in enumerate(turns):
        bit = 1 << i
        tops[starts[i]] = tops.get(starts[i], 0) | bit
        ending[lengths[i]] = ending.get(lengths[i], 0) | bit
        for p, item in enumerate(said):
            postings[p, item] = postings.get((p, item), 0) | bit
    stack = []
    for key, bits in tops.items():
        if base == 0:
            yield 0, key, None, 0, _ids(bits, ids), _ids(bits & ending.get(0, 0), ids)
        stack.append((bits, base, key))
    while stack:
        bits, depth, key = stack.pop()
        place = depth - base
        rest = bits & ~ending.get(depth, 0)
        if place == width:
            continue
        while rest:
            i = (rest & -rest).bit_length() - 1
            item = turns[i][place]
            child = rest & postings[place, item]
            rest ^= child
            below = borders[i] if place + 1 == width else hashlib.blake2b(key + item, digest_size=16).digest()
            yield depth + 1, below, key, sizes[i][place], _ids(child, ids), _ids(child & ending.get(depth + 1, 0), ids)
            stack.append((child, depth + 1, below))


def _walk_table(table: pa.Table) -> pa.Table:
    table = table.sort_by("conv_id")
    cols = {name: table[name].to_pylist() for name in table.column_names}
    pack = struct.Struct("<qq").pack
    starts = [pack(a, b) for a, b in zip(cols["start1"], cols["start2"], strict=True)]
    borders = [pack(a, b) for a, b in zip(cols["end1"], cols["end2"], strict=True)]
    said = [[t["item"] for t in turns] for turns in cols["turns"]]
    sizes = [[t["n_bytes"] for t in turns] for turns in cols["turns"]]
    nodes = list(walk(cols["conv_id"], cols["n_turns"], starts, borders, said, sizes, cols["band"][0] * BAND))
    shard = cols["shard"][0]
    columns = list(zip(*nodes, strict=True)) or [()] * 6
    return pa.Table.from_arrays([pa.array([shard] * len(nodes), pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(NODES_ARROW)[1:], strict=True)]],
                                schema=NODES_ARROW)


def shard_nodes(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every shard's share of every node (``NODES``); a turnless conversation is a member of the root."""
    seq = conversations.repartitionByRange("conv_id").sortWithinPartitions("conv_id").withColumn("seq", F.monotonically_increasing_id())
    shards = materialize(seq.select("conv_id", "n_turns", F.floor(F.col("seq") / SHARD).alias("shard")), "trie-shards")
    band = F.floor(F.col("pos") / BAND).alias("band")
    hashed = rows.select("conv_id", band, "pos", "item", "n_bytes", F.xxhash64("pos", "item").alias("h1"), F.xxhash64("item", "pos").alias("h2"))
    bands = hashed.groupBy("conv_id", "band").agg(F.bit_xor("h1").alias("own1"), F.bit_xor("h2").alias("own2"),
                                                  F.sort_array(F.collect_list(F.struct("pos", "item", "n_bytes"))).alias("turns"))
    bands = materialize(bands, "trie-bands")
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    keys = bands.select("conv_id", "band", "own1", "own2", *[F.coalesce(F.bit_xor(f"own{k}").over(earlier), F.lit(0)).alias(f"start{k}") for k in (1, 2)])
    keys = keys.select("conv_id", "band", "start1", "start2", *[F.col(f"start{k}").bitwiseXOR(F.col(f"own{k}")).alias(f"end{k}") for k in (1, 2)])
    walked = bands.select("conv_id", "band", "turns").join(keys, ["conv_id", "band"]).join(shards, "conv_id")
    none = F.lit(0).cast("long")
    turnless = shards.where("n_turns = 0").select("conv_id", none.alias("band"), F.array().cast(bands.schema["turns"].dataType).alias("turns"),
                                                  *[none.alias(c) for c in ("start1", "start2", "end1", "end2")], "n_turns", "shard")
    return walked.unionByName(turnless).groupBy("shard", "band").applyInArrow(_walk_table, NODES)


# ---------------------------------------------------------------- the whole trie


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, key, shard, ids) to one row per node: the SHA-256 of all ids, joined by commas in the order of the shards."""
    ordered = ends.repartition("depth", "key").sortWithinPartitions("depth", "key", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for depth, key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "ids")), strict=True):
                if (depth, key) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (depth, key), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _digest_batch(out)
        yield _digest_batch([(*node, digest.hexdigest())] if node else [])

    return ordered.mapInArrow(run, "depth long, key binary, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    depth, key, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(key, pa.binary()), pa.array(digest, pa.string())], ["depth", "key", "ends_sha256"])


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over ``number_turns`` results.

    conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves (childless nodes in the subtree),
    saved_tokens (over the subtree, members but one times the bytes of the
    node's last text) and ends_sha256 (ids of the members that end there).
    """
    shares = materialize(shard_nodes(rows, conversations), "trie-shares")
    node = ["depth", "key"]
    nodes = shares.groupBy(node).agg(F.min(F.col("members")[0]).alias("conv_id"), F.sum(F.size("members").cast("long")).alias("n_convs"),
                                     F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"))
    nodes = materialize(nodes, "trie-nodes")
    above = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(above, F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, node, "left").select(
        *node, "conv_id", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "trie-own")
    # What each conversation owns: in all, and from each of its own nodes downwards.
    band = F.floor(F.col("depth") / BAND).alias("band")
    totals = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("all_leaf"), F.sum("saved").alias("all_saved"))
    per_band = nodes.groupBy("conv_id", band).agg(F.sum("leaf").alias("b_leaf"), F.sum("saved").alias("b_saved"))
    above_bands = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    above_nodes = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_band.select("conv_id", "band", *[F.coalesce(F.sum(f"b_{c}").over(above_bands), F.lit(0)).alias(f"b_{c}") for c in ("leaf", "saved")])
    higher = nodes.select("*", band).select("*", *[F.coalesce(F.sum(c).over(above_nodes), F.lit(0)).alias(f"n_{c}") for c in ("leaf", "saved")])
    higher = higher.join(carried, ["conv_id", "band"])
    below = shares.select(*node, F.explode("members").alias("conv_id")).join(totals, "conv_id")
    below = below.groupBy(node).agg(F.sum("all_leaf").alias("m_leaf"), F.sum("all_saved").alias("m_saved"))
    ends = shares.where(F.size("ends") > 0).select(*node, "shard", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    # All members' sums, less what the top's owner owns above this node.
    whole = lambda c: (F.col(f"m_{c}") - F.col(f"n_{c}") - F.col(f"b_{c}"))
    out = higher.join(below, node).join(_end_digests(ends), node, "left").join(parents, ["depth", "parent"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", whole("leaf").alias("n_leaves"), whole("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def build(turns: DataFrame) -> DataFrame:
    """The prefix trie of a conversations table (conv_id, turn, role, text)."""
    return trie(*number_turns(turns))

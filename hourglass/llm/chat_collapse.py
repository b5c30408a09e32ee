"""Collapse of cumulative conversation snapshots, then chat rendering.

A logger that stores a conversation after every exchange leaves many
conversations that are beginnings of longer ones.  Every turn prefix of every
conversation gets a rolling hash; a conversation whose whole hash is the hash
of a proper prefix of another is dropped by an anti-join, equal conversations
are folded into the smallest id, and the rest are rendered.

The rolling hash of a prefix is the running XOR of two independent 64-bit
hashes of (position, role, text), so it can be summed in any grouping.

Only DataFrame functions are used.  Scale: hashing works on rows of hashes,
not texts.  The distinct rows are range-partitioned in the order of
conversation, turn, role and text hash and numbered there; positions and
running hashes are taken within chunks of ``CHUNK_ROWS`` numbers and carried
over chunk totals.  So any large conversation is spread over tasks, also one
of null ids, null turns or repeated turn numbers.  Prefix hashes and equal
conversations are folded before the anti-join (map-side partial
aggregation), so a first turn or a conversation that a third of all rows
share is one row there.  Rendered rows hold at most ``PART_TURNS`` turns;
only the texts of conversations longer than that are joined with positions.

Defined cases: null roles and texts count as empty; rows repeated in all four
columns count once; turns with the same number are ordered by role, then by
text hash; null turn numbers come last; null conversation ids are one
conversation.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourglass.session import materialize

PART_TURNS = 256
CHUNK_ROWS = 1024  # a power of two
KEY = ["conv_id", "turn", "role", "text_hash", "text_hash2"]


def _turns(turns: DataFrame) -> DataFrame:
    """Turn rows with defaults and the text hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
                        F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit("second"), text).alias("text_hash2"))


def _chunked(turns: DataFrame) -> DataFrame:
    """The distinct turns' keys with ``seq``, which grows in their order, and ``chunk``, a run of at most ``CHUNK_ROWS`` of them."""
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text_hash", "text_hash2"]
    rows = _turns(turns).select(*KEY).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("seq", F.monotonically_increasing_id()), "turns")
    return rows.withColumn("chunk", F.floor(F.col("seq") / CHUNK_ROWS).cast("long"))


def _placed(chunked: DataFrame) -> DataFrame:
    """``chunked`` rows of whole conversations with position (from 1) and n_turns."""
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("seq")))
    chunks = chunked.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.sum("n").over(whole).alias("n_turns"))
    at = placed.alias("p").join(chunks.alias("b"), F.expr("p.conv_id <=> b.conv_id and p.chunk = b.chunk"))
    return at.select("p.*", (F.col("before") + F.col("place")).alias("position"), "n_turns").drop("place")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """One row per distinct turn: conv_id, position (from 1), n_turns and the two rolling prefix hashes."""
    return _prefix_hashes(_chunked(turns))


def _prefix_hashes(chunked: DataFrame) -> DataFrame:
    hashed = _placed(chunked).select("conv_id", "chunk", "position", "n_turns",
                                     F.xxhash64("position", "role", "text_hash").alias("h1"),
                                     F.xxhash64("role", "text_hash2", "position").alias("h2"))
    running = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rolled = hashed.withColumns({"r1": F.bit_xor("h1").over(running), "r2": F.bit_xor("h2").over(running)})
    totals = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    totals = totals.select("conv_id", "chunk", F.coalesce(F.bit_xor("t1").over(earlier), F.lit(0)).alias("c1"),
                           F.coalesce(F.bit_xor("t2").over(earlier), F.lit(0)).alias("c2"))
    return (rolled.alias("r").join(totals.alias("t"), F.expr("r.conv_id <=> t.conv_id and r.chunk = t.chunk"))
            .select("r.conv_id", "position", "n_turns", F.col("r1").bitwiseXOR(F.col("c1")).alias("prefix1"),
                    F.col("r2").bitwiseXOR(F.col("c2")).alias("prefix2")))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that begin no other one; of equal ones the smallest id."""
    return _maximal(_chunked(turns))


def _maximal(chunked: DataFrame) -> DataFrame:
    prefixes = materialize(_prefix_hashes(chunked), "prefixes")
    key = ["n_turns", "prefix1", "prefix2"]
    whole = (prefixes.where("position = n_turns").groupBy(key)
             .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    proper = prefixes.where("position < n_turns").select(F.col("position").alias("n_turns"), "prefix1", "prefix2").distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", "n_turns", "n_copies")


def collapse(turns: DataFrame, open_tag: str = "<|im_start|>", close_tag: str = "<|im_end|>") -> DataFrame:
    """The maximal conversations rendered: conv_id, part, n_turns, n_copies, text.

    A part holds ``PART_TURNS`` turns, so a row's size does not grow with the
    conversation; nearly every conversation is one part (0).  The parts in
    order are the whole text.
    """
    chunked = _chunked(turns)
    kept = materialize(_maximal(chunked), "maximal")
    out = ["conv_id", "part", "n_turns", "n_copies"]
    rows = _turns(turns).alias("t").join(kept.alias("k"), F.expr("t.conv_id <=> k.conv_id")).select("t.*", "n_turns", "n_copies")
    said = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "role", "text_hash", "text_hash2", "text")
    short = (rows.where(F.col("n_turns") <= PART_TURNS).select("conv_id", F.lit(0).cast("long").alias("part"), "n_turns", "n_copies", said.alias("said"))
             .groupBy(*out).agg(F.sort_array(F.collect_set("said")).alias("said")))
    long = kept.where(F.col("n_turns") > PART_TURNS)
    texts = rows.where(F.col("n_turns") > PART_TURNS).groupBy(*KEY, "n_turns", "n_copies").agg(F.first("text").alias("text"))
    at = _placed(chunked.alias("t").join(long.alias("k"), F.expr("t.conv_id <=> k.conv_id"), "left_semi")).select(*KEY, "position")
    same = " and ".join(f"t.{c} <=> p.{c}" for c in KEY)
    placed = texts.alias("t").join(at.alias("p"), F.expr(same)).select("t.*", "position")
    parts = (placed.select("conv_id", F.floor((F.col("position") - 1) / PART_TURNS).cast("long").alias("part"), "n_turns", "n_copies",
                           F.struct("position", "role", "text").alias("said"))
             .groupBy(*out).agg(F.sort_array(F.collect_list("said")).alias("said")))

    def rendered(groups: DataFrame) -> DataFrame:
        lines = F.transform("said", lambda s: F.concat(F.lit(open_tag), s["role"], F.lit("\n"), s["text"], F.lit(close_tag + "\n")))
        return groups.select(*out, F.array_join(lines, "").alias("text"))

    return rendered(short).unionByName(rendered(parts))

"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint takes, at each bit, the majority over the XXH64 values
of the text's word shingles.  Fingerprints at most four bits apart are
linked.  Each is cut into segments of 21, 21 and 22 bits.  Of four errors

- a segment may get none: the segment itself is the key, or
- every segment gets one: then two segments get exactly one each, and each
  of these two words decodes to a codeword index near the other word.

For the second case each pair of segments gives keys (indices within
distance 4 of the first word) x (nearest index of the second) and the other
way round; two words with one error each share one of them.  So the keys
miss no link.  Fingerprints that share a key are verified bit by bit.

Scale: only distinct fingerprints take part, so copies cost one row.  A key
shared by more than ``TILE`` fingerprints is cut into tiles of about that
size and every pair of tiles becomes a bounded group of its own, so no task
holds a hot key whole and no comparison is left out.  A group emits a
spanning forest of its links, not all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm import golay
from hourglass.llm.components import connected_components
from hourglass.llm.rows import KEY, drop_losers, with_key
from hourglass.session import materialize, release

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
TILE = 2048
SMALL_GROUP = 16
_BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The text's words, a megabyte at a time, so a very long text needs bounded memory."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + _BLOCK_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _count_bits(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    import xxhash
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64), n


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; null and wordless texts have 0, fewer words than a shingle are one shingle."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + block
        if len(words) >= shingle:
            ones, n = _count_bits(words, shingle)
            counts, total = counts + ones, total + n
        tail = words[-(shingle - 1):] if shingle > 1 else []
    if not total and tail:
        counts, total = _count_bits(tail, len(tail))
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Row key, id and ``fp`` (signed long) of every document."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    keyed = with_key(docs.select(F.col(id_col), F.col(text_col)), id_col, F.col(text_col))
    return keyed.select(*KEY, F.col(id_col), fp(text_col).alias("fp"))


def _keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) rows of distinct fingerprints; the top bits of a key name its segments."""
    words = [(fps.view(np.uint64) >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, owners = [], []
    for s, w in enumerate(words):
        keys.append((3 + s) << 24 | w)
        owners.append(fps)
    for p, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        home_a, home_b = golay.home(words[a]), golay.home(words[b])
        near_a, real_a = golay.near(words[a])
        near_b, real_b = golay.near(words[b])
        real_b[:, 0] = False  # (home, home) comes from the other side already
        for grid, real in (((p << 24) | near_a << 12 | home_b[:, None], real_a), ((p << 24) | home_a[:, None] << 12 | near_b, real_b)):
            keys.append(grid[real])
            owners.append(np.broadcast_to(fps[:, None], grid.shape)[real])
    return np.concatenate(keys), np.concatenate(owners)


def _emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        key, fp = _keys_of(batch["fp"].to_numpy(np.int64))
        yield pd.DataFrame({"key": key.astype(np.int32), "fp": fp})


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits


def _forest(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Spanning-forest edges of one group: each member is compared with those not reached yet."""
    edges, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            hit = _near(rest, node, max_bits)
            reached, rest = rest[hit], rest[~hit]
            if len(reached):
                edges.append(np.stack((np.full(len(reached), node), reached), axis=1))
                queue.extend(reached)
    return edges


def _links(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by group; the last group of a batch is held until it is whole."""
        held: np.ndarray | None = None
        for batch in batches:
            rows = batch[["key", "ti", "tj", "fp"]].to_numpy(np.int64)
            rows = rows if held is None else np.concatenate((held, rows))
            starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))) if len(rows) else np.zeros(0, int)
            if len(starts) < 2:
                held = rows
                continue
            held = rows[starts[-1]:]
            yield from work(rows[:starts[-1]], starts)
        if held is not None and len(held):
            yield from work(held, np.array([0, len(held)]))

    def work(rows: np.ndarray, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        fps, sizes = rows[:, 3].copy(), np.diff(starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        edges = []
        for step in range(1, SMALL_GROUP):
            same = (group[step:] == group[:-step]) & small[step:]
            if not same.any():
                break
            at = np.flatnonzero(same)
            at = at[_near(fps[at], fps[at + step], max_bits)]
            edges.append(np.stack((fps[at], fps[at + step]), axis=1))
        for g in np.flatnonzero(sizes > SMALL_GROUP):
            edges += _forest(np.unique(fps[starts[g]:starts[g + 1]]), max_bits)
        if edges:
            pairs = np.unique(np.concatenate(edges), axis=0)
            yield pd.DataFrame(pairs, columns=["a", "b"])
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp`` that connect all pairs at most ``max_bits`` apart.

    The edges join exactly the fingerprints that a comparison of all pairs
    would join, directly or through others.  ``max_bits`` is at most 4.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys hold for at most {MAX_BITS} differing bits")
    keys = materialize(fps.mapInPandas(_emit_keys, "key int, fp long"), "golay-keys")
    hot = (keys.groupBy("key").count().where(F.col("count") > tile)
           .select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    tiled = keys.join(materialize(hot, "golay-hot"), "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = (tiled.withColumn("own", F.coalesce(own, F.lit(0)))
             .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
             .select("key", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "fp"))
    grouped = tiled.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "fp")
    return grouped.mapInPandas(_links(max_bits), "a long, b long")


def clusters(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp``, ``label`` (smallest fingerprint of its component) for every distinct ``fp`` of ``prints``."""
    distinct = materialize(prints.select("fp").distinct(), "fps")
    found = materialize(connected_components(links(distinct, max_bits)), "components")
    out = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return out.select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: row key, id, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links; null only if
    no document of the component has an id.  Null text counts as empty, and
    all wordless texts (fingerprint 0) are linked with each other.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    labels = materialize(clusters(prints, max_bits), "labels")
    lowest = prints.groupBy("fp").agg(F.min(id_col).alias("lowest"))
    ids = materialize(labels.join(lowest, "fp").groupBy("label").agg(F.min("lowest").alias("component_id")), "lowest")
    by_fp = materialize(labels.join(ids, "label").select("fp", "label", "component_id"), "by-fp")
    release(labels, ids)
    return prints.join(by_fp, "fp").select(*KEY, F.col(id_col), "fp", "label", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one row of each component: the smallest id (nulls last), then the smallest text hash."""
    rows = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    rank = F.struct("_row_null", "_row_id", "_row_hash")
    best = rows.groupBy("label").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = materialize(best.select("label", "best"), "best")
    members = materialize(rows.join(best, "label").select(*KEY, (rank == F.col("best")).alias("stays")), "members")
    return drop_losers(docs, members, id_col, F.col(text_col))

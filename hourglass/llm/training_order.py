"""Training-order materialisation: a keyed permutation of all sequences, written as fixed-stride shards.

Documents are tokenised; the ids of a task's documents, each followed by the
end id, form one stream that is cut into sequences of ``seq_len`` ids (only a
task's last sequence is shorter and padded).  Every sequence has a dense
index: its task's offset plus its place in the task's output, as stored in
the written sequence table.  A four-round Feistel network on an even-width
domain of less than four times N values, cycle-walked until the value is
below N, permutes the indices: the result is the sequence's global slot.
Slots are cut into shards of a fixed number of records; a record is the
padded ids in a fixed number of bytes, so slot s lies in shard s // per_shard
at byte (s % per_shard) * stride, and a reader can stop and go on anywhere.
A range partition writes ``shards_per_task`` whole shards, one after the
other, so the number of tasks does not depend on the size of a shard.

Scale: the sequences are written once and shuffled once, by shard, as
compressed records; they are sorted compressed, too, and unpacked while a
shard is written, so a task holds no unpacked shard.  The permutation is computed per row, so there is no
global sort.  Only a row count per task reaches the driver.  Shards are
written by Spark's own text writer (records are raw bytes ended by one line
feed), so they land in any store that Spark writes to and a lost task is
simply repeated.  The order depends on the key and on how the input's rows
are split into tasks; the written index records it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm.tokens import check_splittable, rest, tokenizer
from hourglass.session import materialize, release, scratch_dir

SEQ_LEN = 4096
PER_SHARD = 1024
SHARDS_PER_TASK = 8
_SLICE = 256
ROUNDS = 4


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing function (multiply, xor-shift)."""
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of ``index`` under the keyed permutation of range(n)."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def feistel(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key * ROUNDS + r) & low)
        return left << np.uint64(half) | right

    slots = index.astype(np.uint64)
    outside = np.ones(len(slots), bool)
    with np.errstate(over="ignore"):
        while outside.any():  # cycle-walking: the domain is under four times n, so few steps are left each time
            slots[outside] = feistel(slots[outside])
            outside = slots >= np.uint64(n)
    return slots.astype(np.int64)


def _kind(id_bytes: int) -> str:
    return {2: "<u2", 4: "<u4"}[id_bytes]


def sequences(docs: DataFrame, tokenizer_path: str, end_id: int, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
              seq_len: int = SEQ_LEN, id_bytes: int = 2) -> DataFrame:
    """Written table of all sequences: n_ids, segments, packed record, crc32 (of the padded record), task, place.

    ``segments`` lists the documents inside: id, start (of the part within
    the document's ids) and length.  Null text counts as empty; repeated rows
    give their ids each time.
    """
    check_splittable(tokenizer_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, pending, have = [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def emit() -> None:
            record = np.full(seq_len, pad_id, _kind(id_bytes))
            record[:have] = np.concatenate([ids for _, _, ids in pending])
            record = record.tobytes()
            segments = [{"id": name, "start": start, "length": len(ids)} for name, start, ids in pending]
            rows.append((have, segments, squeeze(record), zlib.crc32(record)))

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["n_ids", "segments", "packed", "crc32"])
            rows.clear()
            return out

        for batch in batches:
            for name, text_ids in zip(batch["id"], tokenizer(tokenizer_path).batch(batch["text"]), strict=True):
                ids = np.append(text_ids, np.uint32(end_id))
                if int(ids.max()) >= 1 << 8 * id_bytes:
                    raise ValueError(f"ids need more than {id_bytes} bytes")
                ids, at = ids.astype(_kind(id_bytes)), 0
                while at < len(ids):
                    part = ids[at:at + seq_len - have]
                    pending.append((name, at, part))
                    at, have = at + len(part), have + len(part)
                    if have == seq_len:
                        emit()
                        pending, have = [], 0
                if len(rows) >= _SLICE:
                    yield flush()
        if have:
            emit()
        yield flush()
        rest()

    segment = f"array<struct<id: {docs.schema[id_col].dataType.simpleString()}, start: long, length: int>>"
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    cut = rows.mapInPandas(run, "n_ids int, segments array<struct<id: string, start: long, length: int>>, packed binary, crc32 long")
    place = F.monotonically_increasing_id()
    return materialize(cut.select("n_ids", F.col("segments").cast(segment).alias("segments"), "packed", "crc32",
                                  F.shiftright(place, 33).alias("task"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "sequences")


def assign_slots(rows: DataFrame, key: int) -> tuple[DataFrame, int]:
    """Add ``slot`` to a written sequence table; also the number of its rows.

    The driver sums up one count per writing task, which is as many as it
    has scheduled itself.
    """
    counts = sorted((r["task"], r["count"]) for r in rows.groupBy("task").count().collect())
    tasks = np.array([t for t, _ in counts], np.int64)
    before = np.concatenate(([0], np.cumsum([n for _, n in counts]))).astype(np.int64)
    total = int(before[-1])

    @F.pandas_udf("long")
    def slot(task: pd.Series, place: pd.Series) -> pd.Series:
        index = before[np.searchsorted(tasks, task.to_numpy(np.int64))] + place.to_numpy(np.int64)
        return pd.Series(permute(index, total, key))

    return rows.withColumn("slot", slot.asNondeterministic()("task", "place")), total  # evaluated once, however often it is used


def write_training_order(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: int, pad_id: int = 0,
                         id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
                         per_shard: int = PER_SHARD, id_bytes: int = 2, shards_per_task: int = SHARDS_PER_TASK) -> DataFrame:
    """Write ``path/shards/shard=K`` and ``path/index``; returns the index table.

    Index: slot, shard, byte_offset, n_ids, segments, crc32 (of the padded
    record).  Empty input writes an empty index and no record.
    """
    rows = sequences(docs, tokenizer_path, end_id, pad_id, id_col, text_col, seq_len, id_bytes)
    slots, total = assign_slots(rows, key)
    stride = seq_len * id_bytes + 1
    placed = slots.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))

    @F.pandas_udf("binary")
    def record(packed: pd.Series) -> pd.Series:
        return packed.map(zstandard.ZstdDecompressor().decompress)

    (placed.select("slot", "shard", "packed").repartitionByRange(max(1, -(-total // (per_shard * shards_per_task))), "shard")
     .sortWithinPartitions("shard", "slot").select(record("packed").cast("string").alias("value"), "shard")
     .write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/shards"))
    (placed.select("slot", "shard", (F.col("slot") % per_shard * stride).alias("byte_offset"), "n_ids", "segments", "crc32")
     .write.parquet(f"{path}/index"))
    release(rows)
    return docs.sparkSession.read.parquet(f"{path}/index")


def read_training_order(spark: SparkSession, path: str, first_slot: int = 0, seq_len: int = SEQ_LEN,
                        per_shard: int = PER_SHARD, id_bytes: int = 2) -> DataFrame:
    """The records from ``first_slot`` on: slot and record (bytes).  Earlier shards are not opened."""
    stride = seq_len * id_bytes + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in batch.itertuples(index=False, name=None):
                if len(content) % stride:
                    raise ValueError(f"shard {shard} is torn: {len(content)} bytes")
                n = len(content) // stride
                for at in range(0, n, _SLICE):
                    places = range(at, min(at + _SLICE, n))
                    yield pd.DataFrame({"slot": [shard * per_shard + i for i in places],
                                        "record": [content[i * stride:(i + 1) * stride - 1] for i in places]})

    files = spark.read.format("binaryFile").load(f"{path}/shards")
    if "shard" not in files.columns:  # nothing was written
        return spark.createDataFrame([], "slot long, record binary")
    files = files.where(F.col("shard") >= first_slot // per_shard)  # prunes folders
    return (files.select(F.col("shard").cast("long"), "content").mapInPandas(run, "slot long, record binary")
            .where(F.col("slot") >= first_slot))


def new_path(spark: SparkSession) -> str:
    return scratch_dir(spark, "training-order")

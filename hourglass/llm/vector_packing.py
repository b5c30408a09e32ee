"""Vector bin packing of training examples.

A sequence has limits on tokens, on segments and on loss-bearing tokens.
Sequences are filled one at a time: of the waiting pieces that fit all three
remaining capacities, the one with the largest dot product between its sizes
and the remaining capacities (both as shares of the limits) is placed.

Scale: no shuffle.  Each task packs the rows of its own partition from a
bounded window of waiting pieces, refilled as sequences are closed; ids leave
the task as soon as their sequence is closed.  Sequence ids carry the
partition number in their upper bits, so they are unique without a count.
Only a task's last sequences can stay short; those are cut into pieces of
power-of-two length, which need no padding, when the caller says that such
lengths are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.tokens import check_splittable, rest, tokenizer

PIECES = ("start long, length long, ids binary, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")
WINDOW = 1024
_PARTITION_SHIFT = 33


@dataclass(frozen=True)
class Limits:
    """Per sequence: tokens, segments, loss-bearing tokens."""
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096

    def vector(self) -> np.ndarray:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")
        return np.array([self.tokens, self.segments, self.loss], float)


#: Instruction data: at most half of a sequence bears loss, so this limit can bind.
INSTRUCTION_LIMITS = Limits(loss=2048)


class Packer:
    """Bounded window of waiting pieces; yields closed sequences as lists of (payload, length).

    A piece is (payload, tokens, loss tokens) and must fit an empty sequence.
    """

    def __init__(self, limits: Limits, window: int = WINDOW):
        self.cap, self.window = limits.vector(), window
        self.payloads: list = [None] * window
        self.sizes = np.zeros((window, 3))
        self.waits = np.zeros(window, bool)
        self.free = list(range(window))

    def add(self, payload, tokens: int, loss: int) -> None:
        slot = self.free.pop()
        self.payloads[slot], self.sizes[slot], self.waits[slot] = payload, (tokens, 1, loss), True

    def close_one(self) -> list:
        """Fill one sequence from the waiting pieces by the dot-product rule."""
        left, chosen = self.cap.copy(), []
        shares = self.sizes / self.cap
        while True:
            fits = np.flatnonzero(self.waits & (self.sizes <= left).all(axis=1))
            if not len(fits):
                return chosen
            slot = int(fits[np.argmax(shares[fits] @ (left / self.cap))])
            chosen.append(self.payloads[slot])
            left -= self.sizes[slot]
            self.payloads[slot], self.waits[slot] = None, False
            self.free.append(slot)

    def push(self, payload, tokens: int, loss: int) -> Iterator[list]:
        if not self.free:
            yield self.close_one()
        self.add(payload, tokens, loss)

    def drain(self) -> Iterator[list]:
        while self.waits.any():
            yield self.close_one()


def cut_points(loss: np.ndarray, limits: Limits) -> list[int]:
    """Ends of the pieces of one example: as long as the token and loss limits allow."""
    ends, at, n = [], 0, len(loss)
    if n and int(loss.sum()) <= limits.loss:  # only the token limit can bind
        return [*range(limits.tokens, n, limits.tokens), n]
    spent = np.concatenate(([0], np.cumsum(loss)))
    while at < n:
        end = min(at + limits.tokens, int(np.searchsorted(spent, spent[at] + limits.loss, "right")) - 1, n)
        ends.append(end)
        at = end
    return ends


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(examples: DataFrame, ids_of, columns: list[str], limits: Limits = Limits(), window: int = WINDOW,
         power_of_two_tail: bool = False, keep: str = "") -> DataFrame:
    """Pack the rows of ``examples``.

    ``ids_of(batch)`` runs in the task and gives, for each row of a pandas
    batch with ``columns``, its ids (numpy ``<u4``) and a boolean array of
    the loss-bearing ones.  ``keep`` is the schema of the columns passed on with every
    piece, for example ``"doc_id long"``.  An example longer than the limits
    is cut; an example without ids gives no piece.  Repeated rows are packed
    as often as they occur.
    """
    names = [c.strip().split()[0] for c in keep.split(",") if c.strip()]
    out_names = names + [c.strip().split()[0] for c in PIECES.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << _PARTITION_SHIFT
        packer, rows, held = Packer(limits, window), [], 0

        def place(pieces: list) -> None:
            nonlocal sequence, held
            offset = 0
            for kept, start, ids, loss, total in pieces:
                rows.append((*kept, start, len(ids), ids.tobytes(), total, int(loss.sum()), sequence, offset))
                offset += len(ids)
                held += len(ids)
            sequence += 1

        def flush() -> pd.DataFrame:
            nonlocal rows, held
            out, rows, held = pd.DataFrame(rows, columns=out_names), [], 0
            return out

        for batch in batches:
            kept_columns = zip(*(batch[c] for c in names), strict=True) if names else repeat(())
            for kept, (ids, loss) in zip(kept_columns, ids_of(batch)):  # noqa: B905
                start = 0
                for end in cut_points(loss, limits):
                    piece = (kept, start, ids[start:end].copy(), loss[start:end].copy(), len(ids))
                    if end - start == limits.tokens:
                        place([piece])
                    else:
                        for closed in packer.push(piece, end - start, int(loss[start:end].sum())):
                            place(closed)
                    start = end
                    if held > 1 << 20:
                        yield flush()
        for closed in packer.drain():
            filled = sum(len(p[2]) for p in closed)
            if power_of_two_tail and filled < limits.tokens - limits.tokens // 64:
                for part in split_sequence(closed, powers_of_two(filled)):
                    place(part)
            else:
                place(closed)
            if held > 1 << 20:
                yield flush()
        yield flush()
        rest()

    schema = f"{keep}, {PIECES}" if keep else PIECES
    return examples.select(columns).mapInPandas(run, schema)


def split_sequence(pieces: list, lengths: list[int]) -> Iterator[list]:
    """Cut the pieces of one sequence into consecutive parts of the given lengths."""
    queue = list(reversed(pieces))
    for length in lengths:
        part, room = [], length
        while room:
            kept, start, ids, loss, total = queue.pop()
            part.append((kept, start, ids[:room], loss[:room], total))
            if len(ids) > room:
                queue.append((kept, start + room, ids[room:], loss[room:], total))
            room -= min(room, len(ids))
        yield part


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                   limits: Limits = Limits(), power_of_two_tail: bool = True) -> DataFrame:
    """Pack plain documents: the tokenizer's ids plus ``end_id``; every id but a document's first bears loss.

    Null text counts as empty (its only id is ``end_id``).  Returns id,
    start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    loss_tokens, sequence_id and offset per piece.
    """
    check_splittable(tokenizer_path)
    end = np.array([end_id], "<u4")

    def ids_of(batch: pd.DataFrame):
        for text_ids in tokenizer(tokenizer_path).batch(batch["text"]):
            ids = np.concatenate((text_ids, end))
            loss = np.ones(len(ids), bool)
            loss[0] = False
            yield ids, loss

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    packed = pack(rows, ids_of, ["id", "text"], limits, power_of_two_tail=power_of_two_tail, keep="id string")
    return packed.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def pack_instructions(examples: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "id",
                      limits: Limits = INSTRUCTION_LIMITS) -> DataFrame:
    """Pack instruction data: ``prompt`` and ``response`` texts; only the response and its ``end_id`` bear loss."""
    check_splittable(tokenizer_path)

    def ids_of(batch: pd.DataFrame):
        both = tokenizer(tokenizer_path).batch(chain.from_iterable(zip(batch["prompt"], batch["response"], strict=True)))
        for prompt in both:
            ids = np.concatenate((prompt, next(both), np.array([end_id], "<u4")))
            yield ids, np.arange(len(ids)) >= len(prompt)

    rows = examples.select(F.col(id_col).cast("string").alias("id"), "prompt", "response")
    packed = pack(rows, ids_of, ["id", "prompt", "response"], limits, keep="id string")
    return packed.withColumn("id", F.col("id").cast(examples.schema[id_col].dataType)).withColumnRenamed("id", id_col)

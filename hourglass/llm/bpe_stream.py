"""Byte-level BPE as a streaming transducer with bounded lookahead, and incremental decoding.

Encoding.  Appending bytes can undo merges near the end of a text, but only
so far back.  ``sufficient_lookahead`` computes a bound from the merge list:
a border between two tokens whose fate differs with and without further bytes
differs because of a rule of lower rank whose left operand ends there, so the
differing borders form a chain of rising ranks, and each step back is at most
one token.  The longest such chain, found rule by rule, is the lookahead.  A
``Transducer`` therefore holds that many bytes and a token back, and emits
what lies before; the emitted ids never change.

Decoding.  ``Utf8Decoder`` is a state machine from bytes to text that holds
back at most three bytes of an unfinished character; wrong bytes become
U+FFFD, one for each longest beginning of a character.

Words: a text is cut at added tokens and into the words of the tokenizer
file's own pattern.  Short words are looked up in a cache of bounded size,
long ones go through a ``Transducer`` in blocks.  Long texts are worked on in
slices between two words.  So memory beside the text itself is bounded,
whatever the length of a text or a word.  Texts with characters that Unicode
versions class differently are cut into words by the tokenizers library.

Scale: rows are handled where they are read; nothing is shuffled, and a lost
task is only run again.

Defined cases: a null text counts as empty and has no ids; rows that repeat
an id are each handled; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 400_000  # of each of two generations
SHORT_WORD = 64  # characters of a cached word
BLOCK = 4096  # bytes of a long word that are fed at once
SLICE = 1 << 19  # characters of a text that are cut into words at once
PIECE_IDS = 1 << 16
NEVER = 1 << 60
# Fixed value: the word pattern of byte-level tokenizer files.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Characters outside the blocks whose classes all Unicode versions agree on.
_UNSURE = regex.compile("[^\x00-՗Ḁ-⁰₠-⯿　-鿿가-힣豈-￿\U0001f000-\U0001faff]")
_BETWEEN = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")  # always a border of two words
# The byte-level alphabet: bytes that are no visible Latin-1 character are numbered from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
BYTE_OF = {chr(b): b for b in range(256) if b not in _HIDDEN} | {chr(256 + k): b for k, b in enumerate(_HIDDEN)}


def as_bytes(token: str) -> bytes:
    """The bytes of a token written in the byte-level alphabet; any other token is its UTF-8."""
    if all(c in BYTE_OF for c in token):
        return bytes(BYTE_OF[c] for c in token)
    return token.encode("utf-8")


# ---------------------------------------------------------------- lookahead


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token border from which on further bytes cannot change it; ``merges`` in rank order.

    The list must be proper: both operands are single bytes or made by
    earlier rules.  ``reach`` of a rule is how far before the end a border
    that this rule merges can differ; the right operand, or its beginning if
    one of its inner borders differs, lies between that border and the
    differing one that causes it.
    """
    made: dict[bytes, list[tuple[bytes, bytes]]] = defaultdict(list)
    endings: dict[bytes, set[bytes]] = {}
    borders: dict[bytes, dict[int, set[int]]] = {}
    reach: list[int] = []
    best: dict[bytes, int] = {}

    def right_ends(token: bytes) -> set[bytes]:
        """The token and all operands that its end can be made of."""
        if token not in endings:
            endings[token] = {token}.union(*(right_ends(right) for _, right in made[token]))
        return endings[token]

    def is_token(part: bytes) -> bool:
        return len(part) == 1 or part in borders

    for rank, (left, right) in enumerate(merges):
        if not (is_token(left) and is_token(right)):
            raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
        whole = [best[end] for end in right_ends(right) if end in best]
        far = len(right) + max(whole, default=0)
        for at, rules in borders.get(right, {}).items():
            if is_token(right[:at]):
                far = max(far, at + max(reach[r] for r in rules))
        reach.append(far)
        best[left] = max(best.get(left, 0), far)
        token = left + right
        if token in borders:
            endings.clear()  # a second way to make the token may change the ends of others
        made[token].append((left, right))
        endings.pop(token, None)
        inner = borders.setdefault(token, {})
        for shift, part in ((0, left), (len(left), right)):
            for at, rules in borders.get(part, {}).items():
                inner.setdefault(at + shift, set()).update(rules)
        inner.setdefault(len(left), set()).add(rank)
    return max(reach, default=0)


# ---------------------------------------------------------------- encoding


class Bpe:
    """The merge rules over ids."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.size = {i: len(t) for t, i in vocab.items()}
        self.byte_ids = [vocab.get(bytes([b])) for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("the vocabulary lacks a byte")
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(merges):
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.lookahead = sufficient_lookahead(merges)

    def encode(self, data: bytes) -> list[int]:
        """The ids of a byte string: always the first pair of the lowest rank is merged."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > SHORT_WORD:
            return self._encode_long(ids)
        rank, made = self.rank, self.made
        ranks = [rank.get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            token = made[low]
            ids[i:i + 2] = [token]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 32 | token, NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(token << 32 | ids[i + 1], NEVER)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links to the neighbours."""
        rank, made, n = self.rank, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != low:
                continue
            ids[i], ids[j] = made[low], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in ids if t >= 0]


class Transducer:
    """One word's bytes in, ids out as soon as they are stable."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.held = bpe, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        stable = len(self.held) - self.bpe.lookahead
        if stable <= 0:
            return []
        out, end = [], 0
        for token in self.bpe.encode(self.held):
            if end + self.bpe.size[token] >= stable:
                break
            out.append(token)
            end += self.bpe.size[token]
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.bpe.encode(self.held), b""
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts to the ids of a byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        model, split = settings["model"], settings["pre_tokenizer"] or {}
        plain = not settings["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        rules = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or model["type"] != "BPE" or any(model.get(r) for r in rules):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = Bpe({as_bytes(t): i for t, i in model["vocab"].items()}, [(as_bytes(a), as_bytes(b)) for a, b in merges])
        self.added = {t["content"]: t["id"] for t in settings["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in settings["added_tokens"]):
            raise ValueError(f"{path}: added tokens with conditions")
        self.added_words = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.library_words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.token_bytes = [b""] * (1 + max([*model["vocab"].values(), *self.added.values()]))
        for token, i in [*model["vocab"].items(), *self.added.items()]:
            self.token_bytes[i] = as_bytes(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = _packed(self.bpe.encode(word.encode("utf-8")))
        if len(self.young) >= CACHED_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def _long_word(self, word: str) -> Iterator[bytes]:
        stream = Transducer(self.bpe)
        for at in range(0, len(word), BLOCK):
            yield _packed(stream.feed(word[at:at + BLOCK].encode("utf-8")))
        yield _packed(stream.finish())

    def _ids(self, words: list[str]) -> Iterator[bytes]:
        found = list(map(self.young.get, words))
        if None in found:
            start = 0
            for i, ids in enumerate(found):
                if ids is None and len(words[i]) > SHORT_WORD:
                    yield b"".join(found[start:i])
                    yield from self._long_word(words[i])
                    start = i + 1
                elif ids is None:
                    found[i] = self.young.get(words[i]) or self._word(words[i])
            found = found[start:]
        yield b"".join(found)

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without added tokens, in lists of bounded size."""
        at = 0
        while at < len(text):
            cut = _BETWEEN.search(text, at + SLICE) if len(text) - at > SLICE else None
            part = text[at:cut.start() if cut else None] if at or cut else text
            at += len(part)
            if _UNSURE.search(part):
                yield [part[a:b] for _, (a, b) in self.library_words(part)]
            elif len(part) <= 2 * SLICE:
                yield WORDS.findall(part)
            else:
                found = WORDS.finditer(part)
                while words := [m.group() for m in islice(found, 10_000)]:
                    yield words

    def pieces(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text (little-endian unsigned 32-bit) in pieces of bounded size."""
        parts = self.added_words.split(text or "") if self.added_words else [text or ""]
        for part in parts:
            if part in self.added:
                yield _packed([self.added[part]])
            else:
                for words in self._words(part):
                    yield from self._ids(words)

    def decode(self, pieces: Iterator[bytes]) -> Iterator[str]:
        """Ids back to text, piece by piece; ids that the tokenizer lacks give nothing."""
        decoder, table = Utf8Decoder(), self.token_bytes
        for piece in pieces:
            for at in range(0, len(piece), 4 * PIECE_IDS):
                ids = np.frombuffer(piece[at:at + 4 * PIECE_IDS], "<u4")
                yield decoder.feed(b"".join(map(table.__getitem__, ids[ids < len(table)].tolist())))
        yield decoder.finish()


# ---------------------------------------------------------------- decoding


def _follows(lead: int) -> tuple[int, int, int]:
    """Of a lead byte: how many bytes follow, and the range of the first of them."""
    if 0xC2 <= lead <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= lead <= 0xEF:
        return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
    if 0xF0 <= lead <= 0xF4:
        return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
    return 0, 0, 0


class Utf8Decoder:
    """Bytes in, text out; the state is the beginning of an unfinished character."""

    def __init__(self):
        self.state = b""

    def feed(self, data: bytes) -> str:
        data = self.state + data
        end = len(data)
        for back in range(1, min(3, end) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            more, low, high = _follows(lead)
            if more >= back and (back == 1 or low <= data[1 - back] <= high):
                end -= back
            break
        self.state = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.state = self.state, b""
        return rest.decode("utf-8", "replace")


# ---------------------------------------------------------------- tables

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, loaded once per Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, part, ids)``: every text's ids as binary parts of at most ``PIECE_IDS`` ids; a text without ids has one empty part."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            ids = batch.column(0)
            for row, text in enumerate(batch.column(1)):
                for part, piece in enumerate(_even(known.pieces(text.as_py()), 4 * PIECE_IDS)):
                    yield pa.RecordBatch.from_arrays([ids.slice(row, 1), pa.array([part], pa.int64()), pa.array([piece], pa.binary())], [id_col, "part", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, part long, ids binary")


def _even(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in runs of ``size``, the last one shorter; no bytes give one empty run."""
    held, n, none = [], 0, True
    for piece in pieces:
        held.append(piece)
        n += len(piece)
        if n >= size:
            whole = b"".join(held)
            for at in range(0, n - n % size, size):
                none = False
                yield whole[at:at + size]
            held, n = [whole[n - n % size:]], n % size
    if n or none:
        yield b"".join(held)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, part, text)`` of ``encode``'s parts; a character cut by a part's end is in the part that ends it.

    The parts of an id come to one task in order and are streamed, so memory
    does not grow with a text.  Ids must not repeat.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        decoder, at = Utf8Decoder(), None
        for batch in batches:
            out = []
            for doc, part, last, ids in zip(*(batch.column(c).to_pylist() for c in (id_col, "part", "last", "ids")), strict=True):
                if (doc, part) != at:
                    decoder = Utf8Decoder()
                at = (doc, part + 1)
                table = known.token_bytes
                text = decoder.feed(b"".join(table[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(table)))
                out.append((doc, part, text + (decoder.finish() if part == last else "")))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(id_col).type, pa.int64(), pa.string()), strict=True)],
                                             [id_col, "part", "text"])

    last = encoded.groupBy(id_col).agg(F.max("part").alias("last"))
    same = encoded.alias("e").join(last.alias("l"), F.expr(f"e.`{id_col}` <=> l.`{id_col}`")).select(f"e.{id_col}", "part", "last", "ids")
    return same.repartition(id_col).sortWithinPartitions(id_col, "part").mapInArrow(run, f"`{id_col}` {kind}, part long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: every text encoded, its ids decoded, and both digested, in one pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            sizes, ids_sums, text_sums = [], [], []
            for text in batch.column(1):
                n, ids_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()

                def counted(text=text, ids_sum=ids_sum):
                    nonlocal n
                    for piece in known.pieces(text.as_py()):
                        n += len(piece) // 4
                        ids_sum.update(piece)
                        yield piece

                for part in known.decode(counted()):
                    text_sum.update(part.encode("utf-8"))
                sizes.append(n)
                ids_sums.append(ids_sum.hexdigest())
                text_sums.append(text_sum.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sums), pa.array(text_sums)],
                                             [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

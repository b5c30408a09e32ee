"""Cached tokenisation of text batches inside Python workers.

A tokenizer file whose pre-tokenizer is the known word pattern encodes a text
piece by piece: letter runs, single digits, runs of other marks.  For texts
of ASCII and Latin-1 letters, where lower-casing and composition are plain,
Arrow splits a few megabytes of texts into pieces and numbers the distinct
ones; only those are looked up in a cache of two generations of bounded
size, new ones go to the tokenizer's own model, and numpy lays the ids out
again.  Any other text goes through the whole tokenizer, chunk by chunk
between ASCII white space, which no token spans.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 150_000
CACHE_CHUNKS = 50_000
KEPT_PIECES = 50_000
_SLICE = 1 << 22
# Fixed value: the pre-tokenizer pattern that the pieces rely on.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for lower-cased ASCII and Latin-1 letters: every piece that is no letter run.
_MARK = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s0-9a-zß-öø-ÿ]+)"
_OTHER = r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|"  # special tokens start with '<|'
_SPACE = re.compile(r"[ \n]")
# The byte-level alphabet: bytes that are no visible Latin-1 character are numbered from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_BYTE_MARKS = {b: 256 + k for k, b in enumerate(_HIDDEN)}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def check_splittable(path: str) -> None:
    """Raise unless the tokenizer file splits texts by the known pattern."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    first = (settings["pre_tokenizer"].get("pretokenizers") or [settings["pre_tokenizer"]])[0]
    if first.get("pattern") != {"Regex": KNOWN_PATTERN} or first.get("behavior") != "Removed" or not first.get("invert"):
        raise ValueError(f"{path}: not a tokenizer of the supported word pattern")


class WordTokenizer:
    """Texts to ids; exactly the ids of the tokenizer file."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache_pieces, self.cache_chunks = cache_pieces, cache_chunks
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        marks = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(_BYTE_MARKS)
        ids = [token.id for token in self.model.tokenize(marks)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.young.get, pieces))
        missing = {p: self.old.get(p) for p, ids in zip(pieces, found, strict=True) if ids is None}
        if not missing:
            return found
        for piece, ids in missing.items():
            if ids is None:
                missing[piece] = self._piece(piece)
        if len(self.young) + len(missing) > self.cache_pieces:
            self.old, self.young = self.young, {}
        self.young.update((p, ids) for p, ids in missing.items() if len(p) <= 64)
        return [missing[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _plain(self, parts) -> list[np.ndarray]:
        """The ids of an Arrow array of texts without other marks."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(parts), pattern=_MARK, replacement=r" \1 ")
        split = pc.ascii_split_whitespace(spaced)
        coded = split.flatten().dictionary_encode()
        per_piece = self._lookup(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(per_piece), "<u4")
        size = np.fromiter(map(len, per_piece), np.int32, len(per_piece)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        piece = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[piece]
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int32)))
        shift = start[piece] - ends[:-1].astype(np.int32)
        ids = flat[np.repeat(shift, sizes) + np.arange(ends[-1], dtype=np.int32)]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in pairwise(cuts)]

    def _other(self, text: str) -> np.ndarray:
        out = []
        for chunk in text.encode("utf-8").split():
            ids = self.chunks.get(chunk)
            if ids is None:
                ids = np.array(self.whole.encode(chunk.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
                if len(self.chunks) >= self.cache_chunks:
                    self.chunks.clear()
                if len(chunk) <= 64:
                    self.chunks[chunk] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        texts = pa.array(parts, pa.large_string())
        other = pc.match_substring_regex(texts, _OTHER)
        plain = iter(self._plain(texts.filter(pc.invert(other))))
        return [self._other(text) if o else next(plain) for text, o in zip(parts, other.to_pylist(), strict=True)]

    def batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text (little-endian unsigned 32-bit).

        A few megabytes are worked on at a time, also within a long text;
        null gives no ids.
        """
        parts: list[str] = []
        size = 0
        for text in texts:
            text, at, begun = text or "", 0, []
            while len(text) - at > _SLICE and (cut := _SPACE.search(text, at + _SLICE)):
                begun += self._encode([text[at:cut.end()]])
                at = cut.end()
            if begun:
                yield from self._encode(parts)
                parts, size = [], 0
                yield np.concatenate(begun + self._encode([text[at:]]))
                continue
            parts.append(text)
            size += len(text)
            if size > _SLICE:
                yield from self._encode(parts)
                parts, size = [], 0
        yield from self._encode(parts)

    def rest(self) -> None:
        """Give memory back at the end of a task, as the worker lives on; the pieces met first, mostly frequent ones, stay."""
        newest = self.young if len(self.young) >= KEPT_PIECES else self.old or self.young
        self.old, self.young = {}, dict(islice(newest.items(), KEPT_PIECES))
        pa.default_memory_pool().release_unused()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, loaded once per Python process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def rest() -> None:
    """``WordTokenizer.rest`` for every tokenizer of the worker."""
    for t in _TOKENIZERS.values():
        t.rest()

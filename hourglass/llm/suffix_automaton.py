"""Generalised suffix automaton over word sequences, with the windows of test items.

An item's windows are its runs of ``window`` consecutive words; a shorter,
non-empty item is one window itself.  ``scan`` streams a document's word ids
through the automaton, tracks the longest match that ends at each word, and
reports which words lie in an occurring window and which items those belong
to.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class ItemAutomaton:
    def __init__(self, items: Sequence[tuple[object, Sequence[bytes]]], window: int):
        self.window = window
        self.names = [name for name, words in items if words]
        self.vocabulary: dict[bytes, int] = {}
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items if words]
        self.shortest = min((min(len(s), window) for s in sequences), default=0)
        self.width = len(self.vocabulary) + 1
        self.step: dict[int, int] = {}  # state * width + word -> state
        self.length, self.link, self._out = [0], [-1], [set()]
        for s in sequences:
            last = 0
            for word in s:
                last = self._extend(last, word)
        del self._out
        self._index_windows(sequences)

    def _state(self, length: int, link: int, words: set[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(set(words))
        return len(self.length) - 1

    def _set(self, state: int, word: int, to: int) -> None:
        self.step[state * self.width + word] = to
        self._out[state].add(word)

    def _split(self, parent: int, word: int, state: int) -> int:
        """A copy of ``state`` that holds its strings no longer than parent's plus one."""
        copy = self._state(self.length[parent] + 1, self.link[state], self._out[state])
        for w in self._out[state]:
            self.step[copy * self.width + w] = self.step[state * self.width + w]
        self.link[state] = copy
        while parent >= 0 and self.step.get(parent * self.width + word) == state:
            self._set(parent, word, copy)
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.step.get(last * self.width + word)
        if known is not None:  # an earlier item has this prefix
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, set())
        at = last
        while at >= 0 and (known := self.step.get(at * self.width + word)) is None:
            self._set(at, word, new)
            at = self.link[at]
        if at >= 0:
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
        return new

    def _index_windows(self, sequences: list[list[int]]) -> None:
        n = len(self.length)
        self.whole: dict[int, list[tuple[int, int]]] = {}  # state -> short items that it spells, with their lengths
        self.items: dict[int, set[int]] = {}  # state of a full window -> items
        order = sorted(range(n), key=self.length.__getitem__)
        self.full = [-1] * n  # the state of the last ``window`` words
        for v in order:
            if self.length[v] >= self.window:
                self.full[v] = v if self.length[self.link[v]] < self.window else self.full[self.link[v]]
        for item, s in enumerate(sequences):
            v = 0
            for word in s:
                v = self.step[v * self.width + word]
                if self.length[v] >= self.window and self.full[v] >= 0:
                    self.items.setdefault(self.full[v], set()).add(item)
            if len(s) < self.window:
                self.whole.setdefault(v, []).append((len(s), item))
        self.spells = [False] * n  # whether a short item ends here or at a suffix
        for v in order[1:]:
            self.spells[v] = v in self.whole or self.spells[self.link[v]]

    def scan(self, words: list[bytes], hit: np.ndarray, found: set) -> None:
        """Set ``hit`` at the words inside occurring windows and add the items' names to ``found``."""
        if not self.shortest:
            return
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        known = np.concatenate(([0], ids >= 0, [0]))
        edge = np.flatnonzero(np.diff(known))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.shortest:  # unknown words end every match, so shorter runs hold no window
                self._run(ids[a:b].tolist(), a, hit, found)

    def _run(self, ids: list[int], offset: int, hit: np.ndarray, found: set) -> None:
        step, link, length, width, window = self.step, self.link, self.length, self.width, self.window
        state = matched = 0
        for at, word in enumerate(ids, offset + 1):
            to = step.get(state * width + word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step.get(state * width + word)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= window:
                hit[at - window:at] = True
                found.update(self.names[i] for i in self.items[self.full[state]])
            if self.spells[state]:
                v = state
                while v > 0 and self.spells[v]:
                    for size, item in self.whole.get(v, ()):
                        if size <= matched:
                            hit[at - size:at] = True
                            found.add(self.names[item])
                    v = link[v]

"""Levenshtein automaton of a word list, intersected with the list's trie.

One automaton recognises every word within the allowed edits of some term.
Its states are sets of (trie node, edits spent); they are made when a word
first needs them and kept, so a word costs one lookup per letter and most
words end after a few letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

KEEP_STEPS = 500_000


def default_edits(term: str) -> int:
    """None below four letters, one below nine, else two."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class TrieAutomaton:
    def __init__(self, terms: Iterable[str], edits: Callable[[str], int] = default_edits):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room = [0]  # most edits that a term below the node allows
        self.allowed: dict[str, int] = {}
        for term in sorted(set(terms)):
            self.allowed[term] = edits(term)
            node = 0
            self.room[0] = max(self.room[0], self.allowed[term])
            for letter in term:
                if letter not in self.children[node]:
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(0)
                    self.children[node][letter] = len(self.children) - 1
                node = self.children[node][letter]
                self.room[node] = max(self.room[node], self.allowed[term])
            self.term[node] = term
        self.start = self._close({0: 0})
        self.forget()

    def forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[dict[int, int]] = [self.start]
        self.numbers: dict[frozenset, int] = {frozenset(self.start.items()): 0}

    def _close(self, spent: dict[int, int]) -> dict[int, int]:
        """Add what is reached by leaving out letters of terms; keep the fewest edits of each node."""
        out, todo = {}, [(n, e) for n, e in spent.items()]
        while todo:
            node, e = todo.pop()
            if e <= self.room[node] and e < out.get(node, 1 << 30):
                out[node] = e
                if e < self.room[node]:
                    todo += [(c, e + 1) for c in self.children[node].values()]
        return out

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.room[node] and e < reached.get(node, 1 << 30):
                reached[node] = e

        for node, e in self.states[state].items():
            reach(node, e + 1)  # the word has a letter too many
            for c, child in self.children[node].items():
                reach(child, e if c == letter else e + 1)
        closed = self._close(reached)
        if not closed:
            to = -1
        else:
            name = frozenset(closed.items())
            to = self.numbers.get(name, -1)
            if to < 0:
                to = self.numbers[name] = len(self.states)
                self.states.append(closed)
        self.steps[state, letter] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, or None; of equally near terms the first by letters."""
        if len(self.steps) > KEEP_STEPS:
            self.forget()
        state, steps = 0, self.steps
        for letter in word:
            to = steps.get((state, letter))
            state = self._step(state, letter) if to is None else to
            if state < 0:
                return None
        ends = [(e, self.term[n]) for n, e in self.states[state].items() if self.term[n] is not None and e <= self.allowed[self.term[n]]]
        if not ends:
            return None
        distance, term = min(ends)
        return term, distance

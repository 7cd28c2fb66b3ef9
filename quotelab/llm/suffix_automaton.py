"""A generalised suffix automaton over words: one state per class of word sequences that end at the same places.

Reading a text through it gives matching statistics: for each word, how many words up to and including it
occur consecutively in some item. Its size is linear in the words of the items, at most two states a word.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """``items``: pairs of a name and a list of words. Sequences shared by items share states."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items = [(name, words) for name, words in items if words]
        for _, words in self.items:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the sequences of ``q`` no longer than those of ``p`` plus ``word``."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def read(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, matched length) for each word that ends a match."""
        next_, link, length, root = self.next, self.link, self.length, self.next[0]
        s = n = 0
        for i, w in enumerate(words):
            if w not in root:
                s = n = 0
                continue
            t = next_[s].get(w)
            if t is None:
                s = link[s]
                while (t := next_[s].get(w)) is None:
                    s = link[s]
                n = length[s]
            s = t
            n += 1
            yield i, s, n

    def states_of(self, words: list[bytes]) -> list[int]:
        """The states of the prefixes of one of the items."""
        out, s = [], 0
        for w in words:
            s = self.next[s][w]
            out.append(s)
        return out

    def by_length(self) -> list[int]:
        return sorted(range(1, len(self.link)), key=self.length.__getitem__)


class WindowIndex:
    """Which items hold the last ``window`` words read; an item with fewer words is one window of its own."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int):
        self.sam = sam = SuffixAutomaton(items)
        self.window = window
        n = len(sam.link)
        #: The state up the suffix links that holds sequences of exactly ``window`` words; 0 where there is none.
        self.exact = [0] * n
        #: The nearest state up the suffix links, itself included, at which a short item ends.
        self.short = [0] * n
        self.holders: dict[int, set] = {}
        self.short_items: dict[int, tuple[int, set]] = {}
        for name, words in sam.items:
            if len(words) < window:
                s = sam.states_of(words)[-1]
                self.short_items.setdefault(s, (len(words), set()))[1].add(name)
        for s in sam.by_length():
            up = sam.link[s]
            if sam.length[s] >= window:
                self.exact[s] = self.exact[up] or s
            self.short[s] = s if s in self.short_items else self.short[up]
        for name, words in sam.items:
            if len(words) >= window:
                for s in sam.states_of(words)[window - 1:]:
                    self.holders.setdefault(self.exact[s], set()).add(name)

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set, int]:
        """(merged spans of words inside occurring windows, names of items with such windows, longest match)."""
        spans: list[list[int]] = []
        names: set = set()
        seen: set[int] = set()
        window, exact, short, longest = self.window, self.exact, self.short, 0
        for i, s, n in self.sam.read(words):
            if n > longest:
                longest = n
            start = i + 1
            if n >= window:
                start = i + 1 - n
                if (e := exact[s]) not in seen:
                    seen.add(e)
                    names |= self.holders[e]
            at = short[s]
            while at:
                size, who = self.short_items[at]
                if size <= n:
                    start = min(start, i + 1 - size)
                    names |= who
                at = short[self.sam.link[at]]
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, names, longest

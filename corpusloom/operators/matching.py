"""Matching-block ratio of two strings: their common blocks, longest first, over their mean length.

A block is the longest run of equal characters between two places, the first of equally long ones in `a`, then in `b`; what is left of it and right of it
is searched likewise. Characters that are popular in a long `b` (more than one in a hundred) begin no block, but blocks grow over them.
"""

from __future__ import annotations

from collections import Counter

#: The length of `b` from which characters can be popular, and how many of them are.
POPULAR_FROM = 200
POPULAR_SHARE = 100


class _Automaton:
    """Suffix automaton of a string without its barred characters; states know where their strings end first."""

    __slots__ = ("first", "link", "longest", "next")

    def __init__(self, text: str, start: int, end: int, barred: set[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.longest, self.first = [-1], [0], [-1]
        last = 0
        for at in range(start, end):
            last = 0 if text[at] in barred else self._extend(last, text[at], at)

    def _state(self, longest: int, first: int, link: int, steps: dict[str, int]) -> int:
        self.next.append(steps)
        self.longest.append(longest)
        self.first.append(first)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: str) -> int:
        copy = self._state(self.longest[p] + 1, self.first[q], self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: str, at: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # after a barred character, a string may be known already
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, q, c)
        new = self._state(self.longest[last] + 1, at, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, q, c)
        return new


def _block(a: str, b: str, a0: int, a1: int, b0: int, b1: int, barred: set[str]) -> tuple[int, int, int]:
    """(start in a, start in b, size) of the longest common block between the bounds."""
    found = _Automaton(b, b0, b1, barred)
    state = size = 0
    i, j, most = a0, b0, 0
    for at in range(a0, a1):
        c = a[at]
        while state and c not in found.next[state]:
            state = found.link[state]
            size = found.longest[state]
        to = found.next[state].get(c)
        state, size = (to, size + 1) if to is not None else (0, 0)
        if size > most:
            i, j, most = at - size + 1, found.first[state] - size + 1, size
    while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
        i, j, most = i - 1, j - 1, most + 1
    while i + most < a1 and j + most < b1 and a[i + most] == b[j + most]:
        most += 1
    return i, j, most


def matched(a: str, b: str, enough: float | None = None) -> int:
    """Characters in common blocks; with `enough`, any number on the same side of it, as soon as that is certain."""
    popular = {c for c, n in Counter(b).items() if n > len(b) // POPULAR_SHARE + 1} if len(b) >= POPULAR_FROM else set()
    todo, total = [(0, len(a), 0, len(b))], 0
    open_ = min(len(a), len(b))
    while todo:
        a0, a1, b0, b1 = todo.pop()
        open_ -= min(a1 - a0, b1 - b0)
        i, j, size = _block(a, b, a0, a1, b0, b1, popular)
        if size:
            total += size
            for part in ((a0, i, b0, j), (i + size, a1, j + size, b1)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
        if enough is not None and (total > enough or total + open_ <= enough):
            break
    return total


def ratio(a: str, b: str) -> float:
    """Twice the characters in common blocks over all characters; 1 for two empty strings."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def above(a: str, b: str, limit: float) -> bool:
    """Whether ratio(a, b) > limit; lengths and letters, which bound it, are looked at first."""
    every = len(a) + len(b)
    if not every:
        return 1.0 > limit
    if not 2.0 * min(len(a), len(b)) / every > limit or not 2.0 * (Counter(a) & Counter(b)).total() / every > limit:
        return False
    return 2.0 * matched(a, b, limit * every / 2.0) / every > limit

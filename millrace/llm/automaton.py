"""Regular expressions to minimal deterministic automata over bytes, and scans of whole buffers with them.

Patterns are parsed to a nondeterministic automaton (:class:`Pattern`), subset construction over classes of bytes that
no pattern tells apart makes it deterministic (:func:`determinised`), and refinement of partitions minimises it.
:func:`combined` does the same to the automata of several patterns.  Known syntax: characters, ``\\xHH``, ``\\`` before a sign, ``.``, classes, groups, ``(?:``, ``(?i:``, ``|`` and the repeats
``? * + {m} {m,} {m,n}``; matches are leftmost and as long as can be.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

ALL_BYTES = (1 << 256) - 1
_TOKEN = re.compile(r"\\x(?P<hex>[0-9A-Fa-f]{2})|\\(?P<sign>[^\w\s])|(?P<class>\[\^?)|(?P<open>\((?:\?:|\?i:)?)|(?P<repeat>[?*+]|\{\d+(?:,\d*)?\})|(?P<mark>[)|.])|(?P<plain>[^\\\[\](){}?*+|])", re.S)
_MEMBER = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([^\w\s])|([^\\\]])", re.S)


def _byte(found: re.Match) -> int:
    code = next(int(g, 16) if n == 0 else ord(g) for n, g in enumerate(found.groups()[:3]) if g is not None)
    if code > 127 and found.group(1) is None:
        raise ValueError("characters beyond ASCII are written as bytes")
    return code


class Pattern:
    """The nondeterministic automaton of one pattern: ``moves[state]`` is (bytes, next state), ``free[state]`` its empty moves."""

    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False
        self.moves: list[tuple[int, int] | None] = []
        self.free: list[list[int]] = []
        self.first, self.accept = self._any_of()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at:]!r}")
        if self.accept in self.closed({self.first}):
            raise ValueError(f"{pattern!r} matches nothing")

    def _state(self, move: tuple[int, int] | None = None) -> int:
        self.moves.append(move)
        self.free.append([])
        return len(self.moves) - 1

    def _any_of(self) -> tuple[int, int]:
        first, last = self._state(), self._state()
        while True:
            start, end = self._sequence()
            self.free[first].append(start)
            self.free[end].append(last)
            if self.text[self.at : self.at + 1] != "|":
                return first, last
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        first = last = self._state()
        while self.at < len(self.text) and self.text[self.at] not in ")|":
            began = self.at
            start, end = self._item()
            found = _TOKEN.match(self.text, self.at)
            if found and found["repeat"]:
                item, self.at = (began, self.at), found.end()
                start, end = self._repeated(item, found["repeat"], start, end)
            self.free[last].append(start)
            last = end
        return first, last

    def _repeated(self, item: tuple[int, int], sign: str, start: int, end: int) -> tuple[int, int]:
        after = self.at
        least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign, (0, 0))
        if sign[0] == "{":
            low, comma, high = sign[1:-1].partition(",")
            least, most = int(low), int(high) if high else None if comma else int(low)
        first = last = self._state()
        for n in range(max(least, most or least + (least == 0 and most is None), 1)):
            if n:
                self.at = item[0]
                start, end = self._item()
            gate, out = self._state(), self._state()
            self.free[last].append(gate)
            self.free[gate].append(start)
            self.free[end].append(out)
            if n >= least:
                self.free[gate].append(out)
            last = out
        if most is None:
            self.free[end].append(start)
        self.at = after
        return first, last

    def _item(self) -> tuple[int, int]:
        found = _TOKEN.match(self.text, self.at)
        if not found or found["repeat"] or found["mark"] in (")", "|"):
            raise ValueError(f"unexpected {self.text[self.at:]!r}")
        self.at = found.end()
        if found["open"]:
            outer, self.fold = self.fold, self.fold or "i" in found["open"]
            inside = self._any_of()
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError("a group stays open")
            self.at, self.fold = self.at + 1, outer
            return inside
        if found["class"]:
            wanted = self._members(found["class"] == "[^")
        elif found["mark"]:
            wanted = ALL_BYTES & ~(1 << 10)
        else:
            wanted = 1 << (int(found["hex"], 16) if found["hex"] else _byte(_MEMBER.match(found[0])))
        if self.fold:
            letters = range(ord("a"), ord("z") + 1)
            wanted |= sum(1 << c - 32 for c in letters if wanted >> c & 1) | sum(1 << c for c in letters if wanted >> c - 32 & 1)
        last = self._state()
        return self._state((wanted, last)), last

    def _members(self, negated: bool) -> int:
        wanted = 0
        while self.text[self.at : self.at + 1] != "]":
            found = _MEMBER.match(self.text, self.at)
            if not found:
                raise ValueError("a class stays open")
            low = high = _byte(found)
            self.at = found.end()
            if self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                found = _MEMBER.match(self.text, self.at + 1)
                high, self.at = _byte(found), found.end()
            wanted |= (1 << high + 1) - (1 << low)
        self.at += 1
        return ALL_BYTES & ~wanted if negated else wanted

    def closed(self, states: set[int]) -> set[int]:
        """``states`` and what empty moves lead to."""
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen


@dataclass
class Automaton:
    """``steps[state << shift | class]`` is the next state, shifted; the start is state 0.

    ``accepts`` and ``lives`` hold a bit for each pattern: whether it ends at this state, and whether a match of it
    may have begun.  States from ``first_accept`` on accept something, the others nothing.
    """

    classes: np.ndarray
    shift: int
    steps: np.ndarray
    accepts: np.ndarray
    lives: np.ndarray
    first_accept: int


def determinised(pattern: Pattern) -> Automaton:
    """The minimal automaton of one pattern, to be begun where a match may begin; state 0 is the start."""
    sets = sorted({m[0] for m in pattern.moves if m})
    keys: dict[tuple[bool, ...], int] = {}
    classes = np.array([keys.setdefault(tuple(bool(s >> b & 1) for s in sets), len(keys)) for b in range(256)], dtype=np.uint8)

    def move(now: frozenset[int], byte: int) -> frozenset[int]:
        moved = {m[1] for m in map(pattern.moves.__getitem__, now) if m and m[0] >> byte & 1}
        return frozenset(s for s in pattern.closed(moved) if pattern.moves[s] or s == pattern.accept)

    states, rows = _subsets(frozenset(s for s in pattern.closed({pattern.first}) if pattern.moves[s]), move, classes)
    accepts = np.array([pattern.accept in x for x in states], dtype=np.int64)
    return _minimal(rows, accepts, np.array([bool(x) for x in states], dtype=np.int64), classes)


def combined(alone: list[Automaton]) -> Automaton:
    """One minimal automaton that follows all of ``alone``, each begun again at every byte and up to where it first accepts."""
    both, classes = np.unique(np.stack([a.classes for a in alone]), axis=1, return_inverse=True)
    tables = [(a.steps.reshape(-1, 1 << a.shift) >> a.shift).tolist() for a in alone]
    accepting, living = [a.accepts.tolist() for a in alone], [a.lives.tolist() for a in alone]
    starts, kinds = [(n, 0) for n in range(len(alone))], [a.classes.tolist() for a in alone]

    def move(now: frozenset[tuple[int, int]], byte: int) -> frozenset[tuple[int, int]]:
        moved = ((n, tables[n][s][kinds[n][byte]]) for n, s in (*(x for x in now if not accepting[x[0]][x[1]]), *starts))
        return frozenset(x for x in moved if living[x[0]][x[1]])

    states, rows = _subsets(frozenset(), move, classes.ravel().astype(np.uint8))
    accepts = np.array([sum({1 << n for n, s in x if accepting[n][s]}) for x in states], dtype=np.int64)
    lives = np.array([sum({1 << n for n, _ in x}) for x in states], dtype=np.int64)
    return _minimal(rows, accepts, lives, classes.ravel().astype(np.uint8))


def _subsets(start: frozenset, move: Callable[[frozenset, int], frozenset], classes: np.ndarray) -> tuple[list[frozenset], np.ndarray]:
    """All sets of states that can be reached, and for each the number of the set that a byte of each class leads to."""
    samples = np.unique(classes, return_index=True)[1].tolist()
    known, todo, rows = {start: 0}, [start], []
    for now in todo:
        row = []
        for byte in samples:
            after = move(now, byte)
            if after not in known:
                known[after] = len(todo)
                todo.append(after)
            row.append(known[after])
        rows.append(row)
    return todo, np.array(rows)


def _minimal(rows: np.ndarray, accepts: np.ndarray, lives: np.ndarray, classes: np.ndarray) -> Automaton:
    """States that no input tells apart become one; those that accept are numbered last."""
    block, n = np.unique(np.stack([accepts, lives], axis=1), axis=0, return_inverse=True)[1].ravel(), 0
    while block.max() + 1 > n:
        n = block.max() + 1
        block = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].ravel()
    first = np.unique(block, return_index=True)[1]  # a state of each block
    order = np.lexsort((np.arange(n), block[first] != block[0], accepts[first] != 0))  # the start first
    number = np.empty(n, dtype=np.int64)
    number[order] = np.arange(n)
    kept, shift = first[order], max(1, int(rows.shape[1] - 1).bit_length())
    steps = np.zeros((n, 1 << shift), dtype=np.int32)
    steps[:, : rows.shape[1]] = number[block[rows[kept]]] << shift
    narrow = np.min_scalar_type(int(max(lives.max(), accepts.max())))
    return Automaton(classes, shift, steps.ravel(), accepts[kept].astype(narrow), lives[kept].astype(narrow), int((accepts[kept] == 0).sum()))


def states_of(automaton: Automaton, data: np.ndarray, bounds: np.ndarray, lane: int = 2048) -> np.ndarray:
    """The state after every byte of ``data``, begun anew at each of ``bounds``.

    The bytes are cut into lanes that advance together; a lane within a text first assumes the start state, and what
    the lane before it really ends with is then carried on until both agree, which is so after a few bytes.
    """
    n = len(data)
    kinds, out = automaton.classes[data], np.zeros(n, dtype=np.int32)
    edges = np.unique(np.concatenate([bounds, np.arange(0, n, lane)]))
    edges = edges[edges < n]
    lengths = np.diff(np.r_[edges, n])
    order = np.argsort(-lengths, kind="stable")
    at, lengths = edges[order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if n else 0), side="left")  # lanes longer than t
    now, steps = np.zeros(len(at), dtype=np.int32), automaton.steps
    for t, k in enumerate(running.tolist()):
        place = at[:k] + t
        now = steps[now[:k] + kinds[place]]
        out[place] = now
    ends = bounds[np.searchsorted(bounds, edges, side="right").clip(max=len(bounds) - 1)]
    inner = np.flatnonzero(~np.isin(edges, bounds))
    for cut, end in zip(edges[inner].tolist(), ends[inner].tolist(), strict=True):
        state, p = int(out[cut - 1]), cut
        while p < end:
            state = int(steps[state + int(kinds[p])])
            if out[p] == state:
                break
            out[p] = state
            p += 1
    return out >> automaton.shift

"""Weighted finite-state transducers over word classes, composed into one table.

A symbol is a word class with marks. Scope transducers mark insults and threats that stand near an opener: negation, reported speech, a target. The
insult and threat transducers read the marked symbols; their arcs carry events, and events carry weights. Composition runs over arrays, and so
does the walk: many clauses take a step at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Marks of a symbol.
DENIED, REPORTED, AIMED = 1, 2, 4
MARKS = 8
SYMBOLS = 6 * MARKS
#: How many words a mark reaches at most.
REACH = 8

#: Events, from the mildest on, with the prior weight of a clause that holds one.
EVENTS = {"denied": 1.0, "reported": 1.5, "menace": 3.0, "insult": 4.0, "threat": 4.2, "heaped": 4.5, "aimed": 5.0}
CODE = {e: i + 1 for i, e in enumerate(EVENTS)}


@dataclass
class Transducer:
    """Arrays by state and symbol: the next state, the symbol that goes out, the event of the arc (0: none). State 0 is the first."""

    next: np.ndarray
    out: np.ndarray
    event: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """Both as one: ``other`` reads what this one puts out."""
        m = other.next.shape[0]
        a, b = np.arange(self.next.shape[0]).repeat(m), np.tile(np.arange(m), self.next.shape[0])
        middle = self.out[a]
        rows = b[:, None]
        return Transducer(self.next[a] * m + other.next[rows, middle], other.out[rows, middle], np.maximum(self.event[a], other.event[rows, middle]))


def _plain(states: int) -> Transducer:
    """Copies symbols and counts down to state 0."""
    following = np.maximum(np.arange(states) - 1, 0)[:, None].repeat(SYMBOLS, 1)
    return Transducer(following, np.arange(SYMBOLS)[None].repeat(states, 0), np.zeros((states, SYMBOLS), np.int8))


def _of(cls: int) -> np.ndarray:
    return np.arange(cls * MARKS, (cls + 1) * MARKS)


def scope(opener: int, reach: int, mark: int) -> Transducer:
    """Marks insults and threats up to ``reach`` words after an opener."""
    t = _plain(reach + 1)
    for cls in (INSULT, THREAT):
        t.out[1:, _of(cls)] |= mark
    t.next[:, _of(opener)] = reach
    return t


def insult(reach: int = 4) -> Transducer:
    """An event for each insult: denied, reported, aimed at a target, heaped on one before, or plain."""
    t = _plain(reach + 1)
    for x in _of(INSULT):
        marks = x % MARKS
        t.event[:, x] = CODE["denied"] if marks & DENIED else CODE["reported"] if marks & REPORTED else CODE["aimed"] if marks & AIMED else CODE["insult"]
        if not marks & (DENIED | REPORTED):
            t.next[:, x] = reach
            if not marks & AIMED:
                t.event[1:, x] = CODE["heaped"]
    return t


def threat(reach: int = 4) -> Transducer:
    """A threat is an event with a target up to ``reach`` words behind it, a weaker one with a target before it; denied and reported ones are none."""
    t = _plain(reach + 1)
    for x in _of(THREAT):
        marks = x % MARKS
        if not marks & (DENIED | REPORTED):
            t.next[:, x] = reach
            if marks & AIMED:
                t.event[:, x] = CODE["menace"]
    t.event[1:, _of(TARGET)] = CODE["threat"]
    t.next[1:, _of(TARGET)] = 0
    return t


@cache
def grammar() -> tuple[Transducer, Transducer]:
    """What reads a clause backwards first (reports and targets that follow) and then, marked by it, forwards."""
    back = scope(REPORT, REACH, REPORTED).then(scope(TARGET, 2, AIMED))
    for x in _of(THREAT):  # a threat waits for its target by itself
        back.out[:, x] &= ~AIMED
    ahead = scope(NEGATION, 3, DENIED).then(scope(REPORT, REACH, REPORTED)).then(scope(TARGET, 4, AIMED))
    return back, ahead.then(insult()).then(threat())


def clause_events(kinds: np.ndarray, clause: np.ndarray) -> np.ndarray:
    """The gravest event (its code, 0: none) of each clause; ``kinds`` are the words' classes, ``clause`` their rising clause numbers from 0."""
    n = int(clause[-1]) + 1 if clause.size else 0
    worst = np.zeros(n, np.int8)
    hot = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    if not hot.size:
        return worst
    # only words in reach of an insult or a threat matter: stretches of them, each in one clause
    steps = np.zeros(kinds.size + 1, np.int64)
    np.add.at(steps, np.maximum(hot - REACH, 0), 1)
    np.add.at(steps, np.minimum(hot + REACH + 1, kinds.size), -1)
    near = np.cumsum(steps[:-1]) > 0
    place = np.flatnonzero(near)
    new = np.ones(place.size, bool)
    new[1:] = (np.diff(place) > 1) | (clause[place[1:]] != clause[place[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, place.size))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    symbols = kinds[place].astype(np.int64) * MARKS
    going = np.searchsorted(-size, -np.arange(size[0]), side="left")  # stretches of more words than the step's number
    back, ahead = grammar()
    state = np.zeros(size.size, np.int64)
    for i, m in enumerate(going.tolist()):
        at = begin[:m] + size[:m] - 1 - i
        x = symbols[at]
        symbols[at] = back.out[state[:m], x]
        state[:m] = back.next[state[:m], x]
    state[:] = 0
    best = np.zeros(size.size, np.int8)
    for i, m in enumerate(going.tolist()):
        x = symbols[begin[:m] + i]
        np.maximum(best[:m], ahead.event[state[:m], x], out=best[:m])
        state[:m] = ahead.next[state[:m], x]
    np.maximum.at(worst, clause[place[begin]], best)
    return worst

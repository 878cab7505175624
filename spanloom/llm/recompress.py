"""Recompression of token sequences: rounds of naming runs and pairs.

Each round first names every maximal run of one symbol, then every pair of a left symbol followed by a
right symbol, where a coin drawn from symbol and round says which side a symbol is on.  Names are hashes
of what they stand for, so all tasks name alike and no dictionary is gathered or shuffled.

Every symbol carries the words its existence depends on: those below it, and the neighbours that decided
where it starts and ends.  Two equal stretches of text hold the same symbols wherever those words lie
inside the stretch.  ``anchors`` picks for each window of words the symbol with the most letters that
depends on nothing outside the window, so equal windows have equal anchors in any context; a single word
always qualifies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .text import mix

ROUNDS = 3

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class Level:
    """Symbols in text order: name, words start to end, words low to high on which they depend."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _merged(level: Level, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Level:
    """One symbol for each group that begins at an index in head."""
    last = np.append(head[1:], len(level.name)) - 1
    return Level(name, level.doc[head], level.start[head], level.end[last], np.minimum.reduceat(low, head), np.maximum.reduceat(high, head))


def _neighbours(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol, whether the one before it and the one after it are in its text."""
    same = level.doc[1:] == level.doc[:-1]
    return np.append(False, same), np.append(same, False)


def name_runs(level: Level, words: np.ndarray, turn: int) -> Level:
    n = len(level.name)
    before, after = _neighbours(level)
    # That a symbol is not part of a longer run is seen from the word beyond it, unless that word could
    # begin (or end) an equal symbol: then it depends on the neighbour.  Beyond a text lies another word.
    low, high = np.minimum(level.low, level.start - 1), np.maximum(level.high, level.end + 1)
    back = before & (words[level.end - 1] == words[level.start - 1])
    on = np.flatnonzero(after & (words[level.start] == words[np.minimum(level.end, len(words) - 1)]))
    back = np.flatnonzero(back)
    low[back], high[on] = np.minimum(low[back], level.low[back - 1]), np.maximum(high[on], level.high[on + 1])
    opens = np.ones(n, bool)
    opens[1:] = ~before[1:] | (level.name[1:] != level.name[:-1])
    head = np.flatnonzero(opens)
    if len(head) == n:
        return Level(level.name, level.doc, level.start, level.end, low, high)
    size = np.diff(np.append(head, n))
    name = level.name[head]
    runs = size > 1
    name[runs] = mix(name[runs] * _C1 + size[runs].astype(np.uint64) * _C3 + np.uint64(2 * turn + 1))
    return _merged(level, head, name, low, high)


def name_pairs(level: Level, words: np.ndarray, turn: int) -> Level:
    n = len(level.name)
    before, after = _neighbours(level)
    # The coin is drawn from the symbol's first word, so the side of a right neighbour needs only that word.
    left = (mix(words[level.start] + np.array([turn + 1], np.uint64) * _C2) & np.uint64(1)).astype(bool)
    joins = np.zeros(n, bool)
    joins[:-1] = left[:-1] & ~left[1:] & after[:-1]
    joined = np.append(False, joins[:-1])
    # A pair depends on its two symbols; a left symbol alone on the word after it, a right one alone on the
    # symbol before it.
    low, high = level.low.copy(), level.high.copy()
    back, on = np.flatnonzero(~joined & ~left), np.flatnonzero(~joins & left)
    low[back] = np.minimum(level.start[back] - 1, np.where(before[back], level.low[back - 1], level.start[back] - 1))
    high[on] = np.maximum(level.high[on], level.end[on] + 1)
    head = np.flatnonzero(~joined)
    name = level.name[head]
    pairs = joins[head]
    at = head[pairs]
    name[pairs] = mix(level.name[at] * _C1 + level.name[at + 1] * _C2 + np.uint64(2 * turn))
    return _merged(level, head, name, low, high)


def levels(hashes: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """From words up.  hashes, doc: of each word."""
    at = np.arange(len(hashes))
    found = [Level(hashes, doc, at, at + 1, at, at + 1)]
    for turn in range(rounds if len(hashes) else 0):
        found.append(name_pairs(name_runs(found[-1], hashes, turn), hashes, turn))
    return found


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions of all windows of ``size`` words that lie within one text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


#: Levels below this one are asked only where no higher symbol lies inside the window.
LEAST_HEIGHT = 2


def anchors(found: list[Level], windows: np.ndarray, size: int, letters: np.ndarray) -> np.ndarray:
    """The name of each window's anchor: 16 bits of length, 48 of hash.  letters: bytes in the words before
    each word (one more entry than words)."""
    out = np.zeros(len(windows), np.uint64)
    todo = np.arange(len(windows))
    for height in range(len(found) - 1, -1, -1):
        if height < LEAST_HEIGHT:
            todo = todo[out[todo] == 0]
        if not len(todo):
            break
        level = found[height]
        p = windows[todo]
        # Both bounds rise along the text, so the symbols inside a window are consecutive.
        lo = np.searchsorted(level.low, p)
        n = np.searchsorted(level.high, p + size, side="right") - lo
        long = np.minimum(letters[level.end] - letters[level.start], (1 << 16) - 1).astype(np.uint64)
        key = long << np.uint64(48) | mix(level.name + np.array([height + 1], np.uint64) * _C3) >> np.uint64(16)
        best = out[todo]
        for k in range(int(n.max(initial=0))):
            more = np.flatnonzero(n > k)
            best[more] = np.maximum(best[more], key[lo[more] + k])
        out[todo] = best
    return out

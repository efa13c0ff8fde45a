"""Locally consistent names for repeated passages, by recompression.

A word sequence is rewritten in rounds: first every maximal run of one word
becomes one symbol, then in each round every pair of neighbours (a, b) with a in
one half of all names and b in the other becomes one symbol. Names are hashes of
what they stand for, so they are the same in every document and on every
executor, and halves are taken from the names. Each symbol carries the range of
words that decides it (its *context*): the words it stands for and the
neighbours that were looked at. Two equal stretches of text thus have equal
symbols wherever the context lies inside the stretch.

A window is known by the symbols whose context lies inside it, a function of the
window's words alone, so equal windows are known by equal symbols. Symbols of
the last round are used; a window that holds none takes, from the highest round
of which it holds any, the one of least scrambled name; a window inside one run
of a word holds none of any round.
"""

from __future__ import annotations

import numpy as np

from tidewright.llm import words

ROUNDS = 5
_SENTINEL = np.uint64(0x5A17C0DE5A17C0DE)


class Level:
    """The symbols after a round: names, first words and context ranges, in order."""

    def __init__(self, names: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, wall: np.ndarray):
        self.names, self.start, self.low, self.high, self.wall = names, start, low, high, wall


def runs(names: np.ndarray, wall: np.ndarray) -> Level:
    """Maximal runs of equal names as symbols; ``wall`` marks what separates documents."""
    n = len(names)
    first = np.ones(n, bool)
    first[1:] = (names[1:] != names[:-1]) | wall[1:] | wall[:-1]
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)
    size = (end - start).astype(np.uint64)
    new = np.where(size == 1, names[start], words.join_hashes(names[start], size))
    walls = wall[start]
    low = np.where(walls, start, start - 1)
    high = np.where(walls, end, end + 1)
    return Level(new, start, low, high, walls)


def pairs(level: Level, number: int) -> Level:
    """One round: neighbours from the first and the second half become one symbol."""
    half = (words.mix(level.names + np.uint64(number * 2 + 1)) & np.uint64(1)).astype(bool)
    left, right = ~half & ~level.wall, half & ~level.wall
    opens = np.zeros(len(half), bool)
    opens[:-1] = left[:-1] & right[1:]
    closes = np.zeros(len(half), bool)
    closes[1:] = opens[:-1]
    low, high = level.low.copy(), level.high.copy()
    alone = ~opens & ~closes
    i = np.flatnonzero(alone & left)
    high[i] = level.high[i + 1]
    i = np.flatnonzero(alone & right)
    low[i] = level.low[i - 1]
    names = level.names.copy()
    i = np.flatnonzero(opens)
    names[i] = words.join_hashes(level.names[i], level.names[i + 1])
    high[i] = level.high[i + 1]
    keep = ~closes
    return Level(names[keep], level.start[keep], low[keep], high[keep], level.wall[keep])


class Windows:
    """All windows of some documents, laid out one after another with walls between."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, width: int, rounds: int = ROUNDS):
        self.width = width
        # Layout: wall, words of the first document, wall, words of the second, ..., wall.
        self.begin = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]).astype(np.int64) + 1
        self.counts = counts
        n = int(counts.sum()) + len(counts) + 1
        wall = np.ones(n, bool)
        place = np.arange(len(names)) + np.repeat(np.arange(1, len(counts) + 1), counts)
        wall[place] = False
        laid = np.full(n, _SENTINEL, np.uint64)
        laid[place] = names
        self.names = laid
        # Window starts: every word of a document with width - 1 words after it.
        some = np.maximum(counts - width + 1, 0)
        self.per_doc = some
        first = np.concatenate([[0], np.cumsum(some)])
        self.first = first
        self.starts = np.arange(first[-1]) + np.repeat(self.begin - first[:-1], some)
        self.levels = [runs(laid, wall)]
        for k in range(rounds):
            self.levels.append(pairs(self.levels[-1], k))

    def _within(self, number: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows that start at ``at``: the symbols of a round, and the first and number of those inside each."""
        level, n = self.levels[number], len(self.names) + 2
        real = np.flatnonzero(~level.wall)
        below = np.concatenate([[0], np.cumsum(np.bincount(np.maximum(level.low[real], 0), minlength=n))])
        upto = np.cumsum(np.bincount(level.high[real], minlength=n))
        first = below[at]
        return real, first, np.maximum(upto[np.minimum(at + self.width, n - 1)] - first, 0)

    def _code(self, number: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and code (first word in the document and round) of symbols."""
        start = self.levels[number].start[index]
        doc = np.searchsorted(self.begin, start, "right") - 1
        return doc, (start - self.begin[doc]) << 3 | number

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code, name) of every symbol by which some window is known."""
        top = len(self.levels) - 1
        level = self.levels[top]
        index = np.flatnonzero(~level.wall & (level.high - level.low <= self.width))
        doc, code = self._code(top, index)
        keep = (self.counts[doc] >= self.width) & (level.low[index] >= self.begin[doc]) & (level.high[index] <= self.begin[doc] + self.counts[doc])
        found = [(doc[keep], code[keep], words.mix(level.names[index[keep]] + np.uint64(top)))]
        for number, index, _ in self._lower():
            index = np.unique(index)
            found.append((*self._code(number, index), words.mix(self.levels[number].names[index] + np.uint64(number))))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _lower(self):
        """Windows without a symbol of the last round: (round, symbol, window) from the highest round that has one."""
        top = len(self.levels) - 1
        open_ = np.arange(len(self.starts))
        for number in range(top, -1, -1):
            real, first, count = self._within(number, self.starts[open_])
            has = count > 0
            if number < top:
                scrambled = words.mix(self.levels[number].names[real] ^ np.uint64(number + 1))
                best, most = first[has].copy(), count[has]
                more, step = np.flatnonzero(most > 1), 1
                while len(more):
                    j = first[has][more] + step
                    better = scrambled[j] < scrambled[best[more]]
                    best[more[better]] = j[better]
                    step += 1
                    more = more[most[more] > step]
                yield number, real[best], open_[has]
            open_ = open_[~has]
        self.constant = open_

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Windows that are known by repeated symbols only; ``repeated``: sorted ``document << 35 | code``."""
        top = len(self.levels) - 1
        real, first, count = self._within(top, self.starts)
        doc, code = self._code(top, real)
        single = ~np.isin(doc << 35 | code, repeated)
        before = np.concatenate([[0], np.cumsum(single)])
        take = (count > 0) & (before[first + count] == before[first])
        for number, index, window in self._lower():
            doc, code = self._code(number, index)
            take[window[np.isin(doc << 35 | code, repeated)]] = True
        take[self.constant] = True
        take &= ~self.inside_run()
        return np.flatnonzero(take)

    def inside_run(self) -> np.ndarray:
        """Windows of one word only that the window before equals."""
        same = np.concatenate([[0], np.cumsum(self.names[1:] == self.names[:-1])])
        return same[self.starts + self.width - 1] - same[self.starts - 1] == self.width

    def hashes(self, which: np.ndarray) -> np.ndarray:
        """The names of the windows of the given numbers."""
        at, size = self.starts[which], 1
        found = self.names
        while 2 * size <= self.width:
            found = words.join_hashes(found[:-size], found[size:])
            size *= 2
        if size < self.width:
            rest = self.width - size
            found = words.join_hashes(found[:-rest], found[rest:])
        return words.mix(found[at] + np.uint64(self.width))

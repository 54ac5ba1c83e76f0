"""Maximal periodic stretches of word sequences: all periods of an octave at once, from the boundaries of its tiles."""

from __future__ import annotations

import numpy as np

from inkprobe.llm.wordhash import mix64

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Pairs of a boundary and a period that are compared in one go.
_PAIRS = 1 << 20


def shortest(period):
    """Words that a run of ``period`` has at least."""
    return np.maximum(6, 4 * period)


def octaves(n: int) -> int:
    """Number of period octaves that a text of ``n`` words can have runs of."""
    return (n // 4).bit_length() if n >= 6 else 0


class _Names:
    """Hashes of all stretches of 1, 2, 4, ... words: equal names for equal stretches."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= step:
                self.levels.append(last[:0])
                continue
            self.levels.append(mix64(last[:-step] * _LEFT + mix64(last[step:] * _RIGHT)))
        return self.levels[k]

    def equal(self, k: int, i: np.ndarray, j: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Are the ``2 ** k`` words from i and from j equal? Only looked up where ``may``."""
        out = np.zeros(len(i), bool)
        at = np.flatnonzero(may)
        if len(at):
            names = self.level(k)
            out[at] = names[i[at]] == names[j[at]]
        return out


def _merged(tile: np.ndarray, period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of the stretches of one tile and period that overlap or touch."""
    if not len(tile):
        return tile, period, start, stop
    by = np.lexsort((stop, start, period, tile))
    tile, period, start, stop = tile[by], period[by], start[by], stop[by]
    new = np.r_[True, (tile[1:] != tile[:-1]) | (period[1:] != period[:-1]) | (start[1:] > stop[:-1])]
    at = np.flatnonzero(new)
    return tile[at], period[at], start[at], np.maximum.reduceat(stop, at)


def solve_tiles(
    words: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, own_from: np.ndarray, own_to: np.ndarray, n: np.ndarray
) -> tuple[np.ndarray, ...]:
    """``tile, period, start, stop``: where words of a text equal those one period later, as far as each tile sees.

    Tile t holds ``words[offsets[t]:offsets[t + 1]]``, the words of its text (of ``n`` words) from ``at``, and answers for the octaves ``low`` to
    ``high`` and the boundaries from ``own_from`` to ``own_to``. In octave k (periods of 2 ** k up to twice that) boundaries lie S = 2 ** (k + 1) words apart.
    A run has four periods, so the stretch of equal pairs holds more than S words and thus a boundary. There two Z values
    decide, for each period: how many words after the boundary equal those one period on, and how many words before it do, each up to S. Stretches of
    neighbouring boundaries overlap or touch, so their union is the whole.
    """
    found: list[tuple[np.ndarray, ...]] = []
    names = _Names(words)
    for k in range(int(low.min(initial=64)), int(high.max(initial=-1)) + 1):
        space, half = 2 << k, 1 << k
        tiles = np.flatnonzero((low <= k) & (k <= high))
        first = -(-own_from[tiles] // space) * space
        count = np.maximum(-(-(own_to[tiles] - first) // space), 0)
        tile = np.repeat(tiles, count)
        if not len(tile):
            continue
        nth = np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count)
        boundary = np.repeat(first, count) + nth * space - at[tile] + offsets[tile]
        periods = np.arange(half, space)
        block = max(1, _PAIRS // half)
        for i in range(0, len(tile), block):
            own, b = tile[i : i + block], boundary[i : i + block]
            there = b[:, None] + periods
            end = offsets[own + 1]
            row, column = np.nonzero((there < end[:, None]) & (words[np.minimum(there, len(words) - 1)] == words[b][:, None]))
            if not len(row):
                continue
            own, b, q = own[row], b[row], periods[column]
            begin, end = offsets[own], offsets[own + 1]
            long = names.equal(k, b, b + q, b + q + half <= end)
            long |= names.equal(k, b - half, b + q - half, ~long & (b - half >= begin))
            own, b, q, begin, end = own[long], b[long], q[long], begin[long], end[long]
            after, before = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            most_after, most_before = np.minimum(space, end - b - q), np.minimum(space, b - begin)
            for level in range(k + 1, -1, -1):
                step = 1 << level
                after += step * names.equal(level, b + after, b + q + after, after + step <= most_after)
                before += step * names.equal(level, b - before - step, b + q - before - step, before + step <= most_before)
            use = (after == space) | (before == space) | (after + before + q >= shortest(q))
            shift = (at[own] - begin)[use]
            found.append((own[use], q[use], b[use] - before[use] + shift, b[use] + after[use] + shift))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    tile, period, start, stop = _merged(*(np.concatenate(c) for c in zip(*found)))
    whole = (at[tile] == 0) & (np.diff(offsets)[tile] == n[tile])
    open_ = ~whole & ((start <= own_from[tile]) | (stop >= own_to[tile]))
    use = open_ | (stop - start + period >= shortest(period))
    tile, period, start, stop, whole = tile[use], period[use], start[use], stop[use], whole[use]
    # A tile that is the whole text has whole runs; the same stretch with a multiple of its period is none.
    by = np.lexsort((period, stop + period, start, tile))
    tile, period, start, stop, whole = tile[by], period[by], start[by], stop[by], whole[by]
    same = (tile[1:] == tile[:-1]) & (start[1:] == start[:-1]) & ((stop + period)[1:] == (stop + period)[:-1])
    use = ~(np.r_[False, same][: len(tile)] & whole)
    return tile[use], period[use], start[use], stop[use]

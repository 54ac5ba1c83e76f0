"""Suffix arrays by two-stage sorting, for byte strings of a bounded chunk."""

from __future__ import annotations

import numpy as np

# Symbols in one 64-bit sort key: nine bits each.
_PACK = 7


def _keys(x: np.ndarray) -> np.ndarray:
    """The next ``_PACK`` symbols at every place as one number."""
    padded = np.concatenate([x, np.zeros(_PACK, x.dtype)]).astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for k in range(_PACK):
        out = (out << np.uint64(9)) | padded[k : k + len(x)]
    return out


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1 to 256 of all strings, each string ended by a 0; and the first place of each string."""
    lengths = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.uint16) + 1
    raw[first + lengths - 1] = 0
    return raw, first


def key_ranks(x: np.ndarray) -> np.ndarray:
    """The rank of the next ``_PACK`` symbols at every place, equal for equal ones: small numbers, which sort together with a group."""
    keys = _keys(x)
    by = np.argsort(keys)
    ordered = keys[by]
    out = np.empty(len(x), np.int64)
    out[by] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]) if len(x) else 0
    return out


def suffix_order(x: np.ndarray, depth: int, ranks: np.ndarray | None = None, within: bool = False) -> np.ndarray:
    """Places of ``x`` in the order of the suffixes that begin there, to a depth of ``depth`` symbols at least; with ``within``, no farther than the next 0.

    Only suffixes smaller than the next one are sorted directly. Of the others, those with first symbol c follow from the ranks
    of their successors: buckets are scanned in ascending order of c, in each first the suffixes whose successor begins with a
    smaller symbol, then those before them, and so on along runs of c. The directly sorted ones come last in a bucket.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(x[1:].astype(np.int32) - x[:-1].astype(np.int32))
    step[-1] = -1  # the last suffix is larger than the empty one
    # A run of equal symbols goes the way of its end.
    decided = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(decided[::-1])[::-1]] > 0

    direct = np.flatnonzero(smaller)
    ranks = key_ranks(x) if ranks is None else ranks
    bits = n.bit_length()
    ends = np.append(np.flatnonzero(x == 0), n)
    left = ends[np.searchsorted(ends, direct)] - direct  # symbols before the next 0
    group = np.zeros(len(direct), np.int64)
    order = np.arange(len(direct))  # places in ``direct`` in the order so far
    tied = np.arange(len(direct))
    for at in range(0, depth, _PACK):
        # Sort the tied ones within their groups, then split the groups where keys differ.
        own = direct[order[tied]]
        key = ranks[np.minimum(own + at, n - 1)]
        key[own + at >= n] = 0
        both = (group[tied] << bits) | key
        by = np.argsort(both)
        order[tied] = order[tied][by]
        both = both[by]
        new = np.r_[True, both[1:] != both[:-1]]
        starts = np.flatnonzero(new)
        group[tied] = tied[starts][np.cumsum(new) - 1]
        sizes = np.diff(np.r_[starts, len(tied)])
        going = sizes > 1
        if within:  # a group whose common prefix holds a 0 is ordered as far as it matters
            going &= left[order[tied[starts]]] >= at + _PACK
        tied = tied[np.repeat(going, sizes)]
        if not len(tied):
            break
    ordered = direct[order]

    rank = np.full(n + 1, -1, np.int64)
    counts = np.bincount(x, minlength=257)
    begins = np.cumsum(counts) - counts
    by_symbol = np.flatnonzero(~smaller)
    by_symbol = by_symbol[np.argsort(x[by_symbol], kind="stable")]
    edges = np.searchsorted(x[by_symbol], np.arange(258))
    direct_edges = np.searchsorted(x[ordered], np.arange(258))
    following = np.append(x, 0)
    for c in np.flatnonzero(counts):
        at = begins[c]
        induced = by_symbol[edges[c] : edges[c + 1]]
        ends_run = (following[induced + 1] < c) | (induced == n - 1)
        level = induced[ends_run]
        while len(level):
            level = level[np.argsort(rank[level + 1], kind="stable")]
            rank[level] = at + np.arange(len(level))
            at += len(level)
            before = level - 1
            before = before[before >= 0]
            level = before[(x[before] == c) & ~smaller[before]]
        own = ordered[direct_edges[c] : direct_edges[c + 1]]
        rank[own] = at + np.arange(len(own))
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def common_prefixes(x: np.ndarray, order: np.ndarray, most: int, asked: np.ndarray | None = None, ranks: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most``; none for the first, nor where ``asked`` is false."""
    n = len(x)
    out = np.zeros(n, np.int64)
    padded = np.concatenate([x, np.zeros(1, x.dtype)])
    keys = key_ranks(x) if ranks is None else ranks
    alive = np.arange(1, n) if asked is None else 1 + np.flatnonzero(asked[1:])
    while len(alive):
        a, b = order[alive - 1] + out[alive], order[alive] + out[alive]
        inside = (a < n) & (b < n) & (out[alive] < most)
        alive, a, b = alive[inside], a[inside], b[inside]
        same = keys[a] == keys[b]
        # Where the next keys differ, count symbol by symbol.
        rest, ra, rb = alive[~same], a[~same], b[~same]
        for _ in range(_PACK):
            equal = (ra < n) & (rb < n)
            equal[equal] = padded[ra[equal]] == padded[rb[equal]]
            rest, ra, rb = rest[equal], ra[equal] + 1, rb[equal] + 1
            out[rest] += 1
        alive = alive[same]
        out[alive] += _PACK
    return np.minimum(out, most)


def repeated_starts(strings: list[bytes], places: list[tuple[int, int]], length: int) -> list[np.ndarray]:
    """For each string, the starts of those of its substrings of ``length`` bytes that some string has at a smaller place.

    ``places`` gives document and offset of each string; a substring's place is document, then offset plus start.
    """
    x, first = joined(strings)
    ranks = key_ranks(x)
    order = suffix_order(x, length, ranks, within=True)
    lengths = np.array([len(s) for s in strings])
    string = np.repeat(np.arange(len(strings)), lengths + 1)
    start = np.arange(len(x)) - first[string]
    whole = start + length <= lengths[string]
    # Classes of equal substrings: runs of suffixes with long common prefixes, which hold only whole ones.
    at = whole[order]
    shared = common_prefixes(x, order, length, at & np.r_[False, at[:-1]][: len(at)], ranks)
    klass = np.cumsum(shared < length) - 1
    klass, own = klass[at], order[at]
    document = np.array([d for d, _ in places])[string[own]]
    offset = np.array([o for _, o in places])[string[own]] + start[own]
    by = np.lexsort((offset, document, klass))
    klass, own, document, offset = klass[by], own[by], document[by], offset[by]
    new = np.r_[True, klass[1:] != klass[:-1]] if len(klass) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(klass)), 0)) if len(klass) else np.zeros(0, np.int64)
    later = (document > document[lead]) | (offset > offset[lead])
    hit = np.sort(own[later])
    cut = np.searchsorted(hit, np.r_[first, len(x)])
    return [hit[cut[i] : cut[i + 1]] - first[i] for i in range(len(strings))]

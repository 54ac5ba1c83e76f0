"""Mergeable Misra-Gries summaries of 32-bit hashes in numpy."""

from __future__ import annotations

import numpy as np


def summed(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the sum of counts of each."""
    if counts is None:
        values = np.sort(values)
    else:
        by = np.argsort(values, kind="stable")
        values, counts = values[by], counts[by]
    if not len(values):
        return values, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    if counts is None:
        return values[at], np.diff(np.r_[at, len(values)])
    return values[at], np.add.reduceat(counts, at)


class Summary:
    """Counts of the heavy values of a stream whose total ``mass`` is known.

    With more than ``capacity`` counters, the next largest count is taken from all and what is not above zero goes. Each time that removes at least
    (capacity + 1) times what one value loses, so no value loses ``mass / (capacity + 1)``, which is less than ``threshold``:
    every value of ``threshold`` occurrences survives, in whatever order and parts the stream was added.
    """

    def __init__(self, mass: int, threshold: int):
        self.threshold = threshold
        self.capacity = mass // threshold + 1
        self.lost = 0
        self.values, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((values, counts))
        self._held += len(values)
        if self._held > 4 * self.capacity:
            self._merge()

    def _merge(self) -> None:
        parts = [(self.values, self.counts), *self._waiting]
        self.values, self.counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        self._waiting, self._held = [], 0
        if len(self.values) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            loss = int(np.partition(self.counts, at)[at])
            stay = self.counts > loss
            self.values, self.counts = self.values[stay], self.counts[stay] - loss
            self.lost += loss

    def heavy(self) -> np.ndarray:
        """All values that may have ``threshold`` occurrences."""
        self._merge()
        return self.values[self.counts + self.lost >= self.threshold]


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values as byte planes of their gaps, which compress well; then the counts, one byte each and long ones in full."""
    gaps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    many = counts > 255
    small = np.where(many, 0, counts).astype(np.uint8)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    return planes.tobytes() + small.tobytes() + counts[many].astype("<i8").tobytes()


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8, 4 * n).reshape(4, n)
    values = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)
    counts = np.frombuffer(data, np.uint8, n, 4 * n).astype(np.int64)
    counts[counts == 0] = np.frombuffer(data, "<i8", -1, 5 * n)
    return values, counts

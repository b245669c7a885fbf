"""A logarithmic family of suffix arrays: batches are sorted, merge-scanned against the levels, and equal-sized levels merge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard

#: Bytes of a match.
SIZE = 100
#: Entries of a level that a scan or merge holds as whole strings at a time.
CHUNK = 1 << 15
#: Every EACH-th string of a level is held whole for batches that are FAR times smaller; their places are searched between those.
EACH, FAR = 64, 16


def suffix_array(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` in the order of the SIZE bytes from them (ties as given), and whether each differs from the one before.

    Ranks of 8 bytes are doubled to 64; those from a place and from 36 bytes on make 100."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(2 * SIZE, np.uint8)])
    rank = np.ndarray((n + SIZE,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    for width in (8, 16, 32):
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        rank = (rank[: len(rank) - width] << np.uint64(32)) | rank[width:]
        rank = np.concatenate([rank, np.zeros(width, np.uint64)])
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    key = (rank[at] << np.uint64(32)) | rank[at + SIZE - 64]
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(at), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    return at[order], fresh


@dataclass
class Level:
    """Segments of texts one after the other, and the sorted places of the distinct strings whose earliest known owners they hold."""

    text: np.ndarray
    begins: np.ndarray  # of segments in text
    docs: np.ndarray
    starts: np.ndarray  # of segments in their documents
    order: np.ndarray

    def owners(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.searchsorted(self.begins, at, side="right") - 1
        return self.docs[own], self.starts[own] + at - self.begins[own]

    @cached_property
    def _windows(self) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.append(self.text, np.uint8(1)), SIZE + 1)

    def strings(self, entries: np.ndarray | slice) -> np.ndarray:
        """Entries as whole strings; a last byte 1 makes numpy compare all of them."""
        at = self.order[entries]
        table = self._windows[at] if len(at) else np.zeros((0, SIZE + 1), np.uint8)
        table[:, SIZE] = 1
        return table.view(f"S{SIZE + 1}").reshape(-1)

    @cached_property
    def _fences(self) -> np.ndarray:
        return self.strings(slice(None, None, EACH))

    def places_of(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """A merge-scan: for each entry of the other level its place among these, and whether the entry there is equal.

        Levels of like size are scanned side by side. In a far larger one the scan gallops: from fence to fence, then by halves,
        so a batch costs its own size and not that of all levels."""
        place, equal = np.zeros(len(other.order), np.int64), np.zeros(len(other.order), bool)
        far = len(self.order) > FAR * len(other.order)
        for at in range(0, len(other.order), CHUNK):
            wanted = other.strings(slice(at, at + CHUNK))
            here = slice(at, at + len(wanted))
            place[here], equal[here] = self._galloped(wanted) if far else self._scanned(wanted)
        return place, equal

    def _scanned(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, equal = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        lo = 0
        for base in range(0, len(self.order), CHUNK):
            own = self.strings(slice(base, base + CHUNK))
            last = base + CHUNK >= len(self.order)
            hi = len(wanted) if last else lo + int(np.searchsorted(wanted[lo:], own[-1], side="right"))
            found = np.searchsorted(own, wanted[lo:hi])
            place[lo:hi] = base + found
            equal[lo:hi] = own[np.minimum(found, len(own) - 1)] == wanted[lo:hi]
            lo = hi
            if lo == len(wanted):
                break
        return place, equal

    def _galloped(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fence = np.searchsorted(self._fences, wanted)
        lo, hi = np.maximum((fence - 1) * EACH + 1, 0), np.minimum(fence * EACH, len(self.order))
        while len(some := np.flatnonzero(lo < hi)):
            middle = (lo[some] + hi[some]) // 2
            less = self.strings(middle) < wanted[some]
            lo[some[less]] = middle[less] + 1
            hi[some[~less]] = middle[~less]
        return lo, self.strings(np.minimum(lo, len(self.order) - 1)) == wanted

    def without(self, gone: np.ndarray) -> Level:
        """Less some entries, and the segments that no entry is left of."""
        order = self.order[~gone]
        own = np.searchsorted(self.begins, order, side="right") - 1
        kept = np.unique(own)
        if len(kept) == len(self.begins):
            return Level(self.text, self.begins, self.docs, self.starts, order)
        sizes = np.diff(np.append(self.begins, len(self.text)))[kept]
        begins = np.cumsum(sizes) - sizes
        where = np.repeat(self.begins[kept] - begins, sizes) + np.arange(int(sizes.sum()))
        back = np.zeros(len(self.begins), np.int64)
        back[kept] = np.arange(len(kept))
        return Level(self.text[where], begins, self.docs[kept], self.starts[kept], order - self.begins[own] + begins[back[own]])

    def merged(self, other: Level) -> Level:
        """Both as one; of equal entries the earlier owner's stays."""
        place, equal = self.places_of(other)
        mine, theirs = np.zeros(len(self.order), bool), np.zeros(len(other.order), bool)
        if equal.any():
            a, b = self.owners(self.order[place[equal]]), other.owners(other.order[equal])
            later = (b[0] > a[0]) | ((b[0] == a[0]) & (b[1] >= a[1]))
            theirs[np.flatnonzero(equal)[later]] = True
            mine[place[equal][~later]] = True
        order = np.insert(self.order, place, other.order + len(self.text))
        gone = np.insert(mine, place, theirs)
        both = (np.concatenate(x) for x in ((self.text, other.text), (self.begins, other.begins + len(self.text)), (self.docs, other.docs), (self.starts, other.starts)))
        return Level(*both, order).without(gone)

    def packed(self) -> bytes:
        kinds = ("<i8", "<i8", "<i8", "<i8", "u1")
        parts = [np.ascontiguousarray(x.astype(k)).tobytes() for x, k in zip((self.begins, self.docs, self.starts, self.order, self.text), kinds, strict=True)]
        head = np.array([len(self.begins), len(self.order)], "<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @classmethod
    def unpacked(cls, blob: bytes) -> Level:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        cuts = [16 + 8 * x for x in (0, n, 2 * n, 3 * n, 3 * n + m)]
        begins, docs, starts = (np.frombuffer(raw, "<i8", n, at) for at in cuts[:3])
        return cls(np.frombuffer(raw, np.uint8, offset=cuts[4]), begins, docs, starts, np.frombuffer(raw, "<i8", m, cuts[3]))


Late = tuple[np.ndarray, np.ndarray]


def indexed(text: np.ndarray, begins: np.ndarray, docs: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[Level, Late]:
    """A batch of segments as a level, and the (documents, places) of strings that start earlier elsewhere in the batch."""
    steps = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(begins, windows) + steps
    d, p = np.repeat(docs, windows), np.repeat(starts, windows) + steps
    by_owner = np.lexsort((p, d))  # so that the first of equal strings is the earliest
    order, fresh = suffix_array(text, at[by_owner])
    level = Level(text, begins, docs, starts, order)
    d, p = level.owners(order)
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(order) else order
    late = ~fresh & ((d != d[group]) | (p != p[group]))
    return level.without(~fresh), (d[late], p[late])


def scanned(level: Level, batch: Level) -> tuple[Late, np.ndarray, np.ndarray]:
    """The batch against a level: (documents, places) that start earlier on the other side; which entries of the batch, and of the level, need not be kept."""
    place, equal = level.places_of(batch)
    some = np.flatnonzero(equal)
    mine, theirs = level.owners(level.order[place[some]]), batch.owners(batch.order[some])
    later = (theirs[0] > mine[0]) | ((theirs[0] == mine[0]) & (theirs[1] > mine[1]))
    earlier = (theirs[0] < mine[0]) | ((theirs[0] == mine[0]) & (theirs[1] < mine[1]))
    of_batch, of_level = np.zeros(len(batch.order), bool), np.zeros(len(level.order), bool)
    of_batch[some[~earlier]] = True
    of_level[place[some[earlier]]] = True
    return tuple(np.concatenate([theirs[k][later], mine[k][earlier]]) for k in (0, 1)), of_batch, of_level


class SuffixFamily:
    """Levels by the bit length of their number of entries, so sizes at least double from level to level."""

    def __init__(self) -> None:
        self.levels: dict[int, Level] = {}
        self.merges = 0

    def add(self, text: np.ndarray, begins: np.ndarray, docs: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> Late:
        """Takes a batch of segments in; returns the (documents, places) of strings that turn out to start earlier elsewhere."""
        batch, late = indexed(text, begins, docs, starts, windows)
        found = [late]
        for size, level in list(self.levels.items()):
            late, of_batch, of_level = scanned(level, batch)
            found.append(late)
            if of_batch.any():
                batch = batch.without(of_batch)
            if of_level.any():
                self.levels[size] = level.without(of_level)
        while len(batch.order):
            size = len(batch.order).bit_length()
            other = self.levels.pop(size, None)
            if other is None:
                self.levels[size] = batch
                break
            if len(other.order):
                self.merges += 1
                batch = other.merged(batch)
        return np.concatenate([d for d, _ in found]), np.concatenate([p for _, p in found])

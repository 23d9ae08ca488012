"""Words and word shingles of a batch of texts as numpy arrays, for use inside Arrow tasks.

A batch is worked through in slices of a few megabytes of UTF-8, so that memory is bounded by the slice or by one
text, whichever is larger. Word hashes are multilinear in the bytes of a word with a fixed table of multipliers, so
equal words have equal hashes in every task, and 64 bits make an accidental match unlikely at any corpus size
that fits a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

# White space of the contracts: blank and 0x09 to 0x0D. All are single bytes in UTF-8.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _multipliers(place: np.ndarray) -> np.ndarray:
    """A random-looking odd number for each place in a word; long words go on with mixed numbers."""
    if place.size and place.max() >= 256:
        return np.where(place < 256, _POWERS[np.minimum(place, 255)],
                        mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))
    return _POWERS[place]


class Slice:
    """Consecutive texts of a batch: their bytes (A-Z in lower case with ``fold``), words and word hashes.

    ``rows``: first and last row (exclusive) within the batch. ``start``/``end``: bytes of each word within
    ``data``. ``first``: for each text the index of its first word, with one more entry for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: tuple[int, int], blank: np.ndarray = _BLANK, fold: bool = True):
        self.rows, self.data, self.offsets = rows, _LOWER[data] if fold else data, offsets
        inside = np.zeros(data.size + 2, dtype=np.int8)
        inside[1:-1] = ~blank[data]
        step = np.diff(inside)
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < data.size)]
        start, end = step == 1, step == -1
        touching = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # the last word of a text meets the next text's first
        start[touching] = True
        end[touching] = True
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end)
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        if not self.start.size:
            return np.empty(0, dtype=np.uint64)
        length = self.end - self.start
        where = np.repeat(self.start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        place = where - np.repeat(self.start, length)
        terms = (self.data[where].astype(np.uint64) + np.uint64(1)) * _multipliers(place)
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        return mix(np.add.reduceat(terms, begin))


def parts_of(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most so many bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(sizes), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most_bytes, side="right")))
        yield batch.slice(i, j - i)
        i = j


def slices(texts: pa.Array, blank: np.ndarray = _BLANK, fold: bool = True) -> Iterator[Slice]:
    """The texts of a string array (null counts as empty), a few megabytes at a time."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        yield Slice(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], (i, j), blank, fold)
        i = j


def numbered_slices(batches, fold: bool = True) -> Iterator[tuple[Slice, pa.RecordBatch]]:
    """The texts (column ``text``) of batches in slices, each with its rows. A slice is the same whenever its batch is the same."""
    for batch in batches:
        for s in slices(batch.column("text"), fold=fold):
            yield s, batch.slice(s.rows[0], s.rows[1] - s.rows[0])


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in ascending keys (and the end); shards hold ranges of the first 24 bits."""
    return np.searchsorted((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24), np.arange(shards + 1, dtype=np.uint64))


def planes(x: np.ndarray, first: int = 8) -> bytes:
    """The first bytes of ascending numbers, byte by byte, so that the foremost compress."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T[:first]).tobytes()


def unplaned(b: bytes, first: int = 8) -> np.ndarray:
    """The numbers of ``planes``, with 0 in the bytes that were left out."""
    x = np.zeros((8, len(b) // first), np.uint8)
    x[:first] = np.frombuffer(b, np.uint8).reshape(first, -1)
    return np.ascontiguousarray(x.T).view(">u8").ravel().astype(np.uint64)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and for each text the index of its first one (with one more entry).

    A text with fewer than k words, but at least one, has the whole sequence as its only shingle.
    """
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(made)))
    if not at[-1]:
        return np.empty(0, dtype=np.uint64), at
    begin = np.repeat(first[:-1] - at[:-1], made) + np.arange(at[-1])
    have = np.repeat(np.minimum(counts, k), made)
    out = np.zeros(begin.size, dtype=np.uint64)
    for j in range(k):
        part = words[np.minimum(begin + j, words.size - 1)]
        out = np.where(j < have, mix(out * np.uint64(0xD6E8FEB86659FD93) + part), out)
    return out, at


def distinct_by_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending, and where each row begins."""
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    row = np.repeat(np.arange(at.size - 1), np.diff(at))
    keep = np.ones(values.size, dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(at.size))


class Finder:
    """Looks hashes up in an ascending array of distinct ones: their top bits lead to a few candidates."""

    def __init__(self, hashes: np.ndarray, bits: int):
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(self.first, append=hashes.size).max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are there (indices into ``h``), and their places in the array."""
        if not self.hashes.size or not h.size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        at = self.first[(h >> self.shift).astype(np.int64)]
        np.minimum(at, self.hashes.size - 1, out=at)
        hit = self.hashes[at] == h
        for _ in range(self.most - 1):  # neighbours in the bucket
            rest = np.flatnonzero(~hit & (self.hashes[at] < h) & (at < self.hashes.size - 1))
            if not rest.size:
                break
            at[rest] += 1
            hit[rest] = self.hashes[at[rest]] == h[rest]
        found = np.flatnonzero(hit)
        return found, at[found]

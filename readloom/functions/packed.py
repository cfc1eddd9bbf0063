"""Vectorised base packing over whole Arrow batches (numpy, no per-row Python).

A batch's sequences stay one byte buffer; k-mers of k <= 32 are 2-bit packed into uint64 by doubling
(k-mers of 1, 2, 4, ... bases are joined), so a batch costs O(log k) array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# fixed values: base codes (A C G T in either case), everything else breaks a k-mer
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
_LETTER = np.frombuffer(b"ACGT", np.uint8)


class Batch:
    """Codes of all sequences of a string column, end to end, with row bounds; nulls count as empty."""

    def __init__(self, seqs: pa.Array):
        if isinstance(seqs, pa.ChunkedArray):
            seqs = seqs.combine_chunks()
        seqs = seqs.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
        data = seqs.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) else np.zeros(0, np.uint8)
        self.n = len(seqs)
        self.starts = bounds[:-1] - bounds[0]
        self.lengths = np.diff(bounds)
        self.raw = raw
        self.codes = _CODE[raw]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), self.lengths)

    def valid(self, k: int) -> np.ndarray:
        """True where k consecutive bases of one row start."""
        m = len(self.codes) - k + 1
        if m <= 0:
            return np.zeros(0, bool)
        bad = np.concatenate([[0], np.cumsum(self.codes > 3)])
        return (bad[k:] == bad[:-k]) & (self.row[:m] == self.row[k - 1 :])

    def packed(self, k: int, reverse: bool = False) -> np.ndarray:
        """The k-mer starting at each position (its reverse complement if reverse), undefined where not valid(k)."""
        m = len(self.codes) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        one = (self.codes & 3).astype(np.uint64)
        if reverse:
            one = np.uint64(3) - one
        out, done, size = None, 0, 1
        while True:
            if k & size:
                if out is None:
                    out, done = one, size
                else:
                    a, b = out[: len(one) - done], one[done:]
                    n = min(len(a), len(b))
                    a, b = a[:n], b[:n]
                    out = (b << np.uint64(2 * done)) | a if reverse else (a << np.uint64(2 * size)) | b
                    done += size
            if done == k:
                return out[:m]
            a, b = one[:-size], one[size:]
            one = (b << np.uint64(2 * size)) | a if reverse else (a << np.uint64(2 * size)) | b
            size *= 2

    def canonical(self, k: int) -> np.ndarray:
        """The lower of each k-mer and its reverse complement; A<C<G<T makes this alphabetical order."""
        return np.minimum(self.packed(k), self.packed(k, reverse=True))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(kmers: np.ndarray, k: int) -> pa.Array:
    """Packed k-mers back as strings."""
    kmers = np.ascontiguousarray(kmers).view(np.uint64)
    out = np.empty((len(kmers), k), np.uint8)
    for i in range(k):
        out[:, i] = _LETTER[((kmers >> np.uint64(2 * (k - 1 - i))) & np.uint64(3)).astype(np.intp)]
    offsets = pa.py_buffer((np.arange(len(kmers) + 1, dtype=np.int64) * k).tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(kmers), [None, offsets, pa.py_buffer(out.tobytes())]).cast(pa.string())


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal (sorted) keys."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)

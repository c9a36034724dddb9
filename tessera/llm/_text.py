"""Vectorised kernels over the bytes of a whole Arrow batch of texts: words, hashes, shingles.

Words are ``[^\\x20\\x09-\\x0D]+``. In UTF-8 those separators never occur inside a longer character, so bytes will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_POW: list[np.ndarray] = []
#: Bytes of text that a kernel call works on at once; a longer text alone makes a larger call.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def as_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    edge[offsets[offsets < n]] = True
    starts = np.flatnonzero(~space & edge[:n])
    edge[:n] = space
    edge[offsets] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial over random byte values, from prefix sums, then mixed."""
    n = len(data)
    if not _POW or len(_POW[0]) < n + 1:
        size = max(n + 1, PIECE * 2)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POW[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POW[0][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POW[1][starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of k consecutive words inside a text.

    With ``short``, a text with fewer than k words (but some) gives its whole sequence as one.
    """
    first = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(counts)), counts)
    m = max(0, len(hashes) - k + 1)
    acc = np.full(m, k, np.uint64)
    for i in range(k):
        acc = mix(acc * _U(3) + hashes[i : i + m])
    inside = np.flatnonzero(owner[:m] == owner[k - 1 :]) if m else np.zeros(0, np.int64)
    out, own, at = acc[inside], owner[inside], inside
    if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
        whole = []
        for d in few:
            x = np.full(1, counts[d], np.uint64)
            for h in hashes[first[d] : first[d + 1]]:
                x = mix(x * _U(3) + h)
            whole.append(x[0])
        out, own, at = np.concatenate((out, np.array(whole, np.uint64))), np.concatenate((own, few)), np.concatenate((at, first[few]))
        order = np.argsort(own, kind="stable")
        out, own, at = out[order], own[order], at[order]
    return out, own, at


def grouped_order(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order by owner, then value."""
    order = np.argsort(values)
    own = owner[order]
    return order[np.argsort(own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own, kind="stable")]


def sets(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, one after the other; and their number by text."""
    order = grouped_order(values, owner)
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.bincount(owner[keep], minlength=n)

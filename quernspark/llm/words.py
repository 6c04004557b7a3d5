"""Words of many texts at once, by numpy over their UTF-8 bytes. White space: the six ASCII blanks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK, SLICE = 1 << 16, 1 << 20
BASE = 0x9E3779B97F4A7C15
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTE = np.random.default_rng(3).integers(1, 2**64, 256, dtype=np.uint64)
_powers = np.ones((2, 1), dtype=np.uint64)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Rows [i, j) of about so many bytes each; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(sizes // most)) + 1).tolist()
    yield from ((i, j) for i, j in zip([0, *cuts], [*cuts, len(texts)]) if i < j)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds): text i is bytes[bounds[i]:bounds[i + 1]]; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


class Words:
    """Byte spans of the words of some texts: starts, ends; first[i] words stand before text i."""

    def __init__(self, texts: pa.Array):
        self.data, self.bounds = text_bytes(texts)
        inside = ~BLANK[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cut = self.bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(inside))]  # words end where a text ends
        opens[cut] = inside[cut]
        closes[cut - 1] = inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return stretch_hashes(self.data, self.starts, self.ends, BYTE)

    def whole(self, n: int) -> np.ndarray:
        """For each n successive words: do they stand in one text?"""
        most = max(0, len(self.starts) - n + 1)
        return self.text[:most] == self.text[n - 1 : n - 1 + most]


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE and of its inverse modulo 2 ** 64."""
    global _powers
    if _powers.shape[1] < n:
        base = np.array([[BASE], [pow(BASE, -1, 2**64)]], dtype=np.uint64).repeat(max(n, 2 * BLOCK), axis=1)
        base[:, 0] = 1
        _powers = np.multiply.accumulate(base, axis=1)
    return _powers[:, :n]


def stretch_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each stretch values[lo[i]:hi[i]] (lo and hi ascending, some may be empty): a polynomial modulo 2 ** 64, mixed.

    Worked off in blocks, so that memory beside the values follows the longest stretch.
    """
    out = np.empty(len(lo), dtype=np.uint64)
    cuts = (np.flatnonzero(np.diff(lo // BLOCK)) + 1).tolist()
    for i, j in zip([0, *cuts], [*cuts, len(lo)]):
        if i == j:
            continue
        at, stop = lo[i], hi[j - 1]
        up, down = powers(stop - at + 1)
        part = values[at:stop] if table is None else table[values[at:stop]]
        sums = np.zeros(stop - at + 1, dtype=np.uint64)
        np.cumsum(part * up[:-1], out=sums[1:])
        out[i:j] = (sums[hi[i:j] - at] - sums[lo[i:j] - at]) * down[lo[i:j] - at]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n successive words, given by their hashes."""
    lo = np.arange(max(0, len(words) - n + 1))
    return stretch_hashes(words, lo, lo + n)


def least_places(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of each n successive hashes the place of the least (by its first 40 bits), of equal ones the last."""
    out, low = [np.empty(0, dtype=np.int64)], np.uint64((1 << 24) - 1)
    for at in range(0, len(hashes) - n + 1, 1 << 20):  # bounded, however long the text
        part = hashes[at : at + (1 << 20) + n - 1]
        least = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        many, size = len(part) - n + 1, 1
        while 2 * size <= n:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:many], least[n - size : n - size + many])
        out.append(at + (low - (least & low)).astype(np.int64))
    return np.concatenate(out)

"""Byte spans of many texts at once: maximal runs of chosen bytes, and spans as Arrow strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import text_bytes

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Spans:
    """Maximal runs of bytes that inside (256 booleans) marks, within each text, after A-Z are lower-cased.

    starts and ends are places in data; text is each run's text; first[i] runs stand before text i.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray):
        data, self.bounds = text_bytes(texts)
        self.data = LOWER[data]
        held = inside[self.data]
        opens, closes = held.copy(), held.copy()
        opens[1:] &= ~held[:-1]
        closes[:-1] &= ~held[1:]
        cut = self.bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(held))]  # runs end where a text ends
        opens[cut] = held[cut]
        closes[cut - 1] = held[cut - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds): every run followed by one blank; run i is bytes[bounds[i]:bounds[i + 1] - 1]."""
        sizes = self.ends - self.starts
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(bounds[-1], 0x20, dtype=np.uint8)
        inner = np.ones(len(out), dtype=bool)
        inner[bounds[1:] - 1] = False
        out[inner] = gathered(self.data, self.starts, sizes)
        return out, bounds


def spread(lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places lo[i], lo[i] + 1, ... of all spans, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(lo - before, sizes) + np.arange(int(sizes.sum()))


def gathered(data: np.ndarray, lo: np.ndarray, sizes: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """data[lo[i]:lo[i] + sizes[i]] of all spans, one after the other; places are made for so many spans at once."""
    parts = [data[spread(lo[i : i + most], sizes[i : i + most])] for i in range(0, len(lo), most)]
    return np.concatenate([data[:0], *parts])


def as_strings(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """data[lo[i]:hi[i]] as strings."""
    sizes = hi - lo
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(bounds), pa.py_buffer(gathered(data, lo, sizes)))

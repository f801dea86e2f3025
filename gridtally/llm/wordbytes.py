"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# An odd multiplier; hashes are polynomials in it modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class _Cache(dict):
    """What a process has computed; it is empty when sent to another."""

    def __reduce__(self) -> tuple:
        return _Cache, ()


_powers = _Cache()

BLOCK_BYTES = 2 * 1024 * 1024
# Powers are kept for so many bytes or multiples of it, 16 bytes each.
_POWERS_STEP = 1 << 18


def powers(length: int, inverse: bool = False) -> np.ndarray:
    """The powers of the base, or of its inverse, from 0 to ``length``."""
    name = "inverse" if inverse else "base"
    known = _powers.get(name)
    if known is None or len(known) <= length:
        size = -(-max(length, 1) // _POWERS_STEP) * _POWERS_STEP + 1
        known = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        _powers[name] = known
    return known


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers so that any of their bits may be used."""
    x = hashes.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(word: str) -> np.ndarray:
    """True for the bytes of words: all but white space, or letters, digits and above ASCII."""
    table = np.ones(256, dtype=bool)
    if word == "spaced":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        for first, last in ("09", "az", "AZ"):
            table[ord(first) : ord(last) + 1] = True
    return table


LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of ``data``, without further arrays of 64 bits a byte."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    own = sums[1:]
    own[:] = data
    own += np.uint64(1)
    own *= powers(len(data))[: len(data)]
    np.cumsum(own, out=own)
    return sums


class Words:
    """The lower-cased words of some texts: text, start and end in ``data``, and hash."""

    def __init__(self, texts: list[bytes], word: str):
        self.data = LOWERED[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        inside = byte_table(word)[self.data].view(np.int8)
        edges = np.diff(inside, prepend=np.int8(0))
        self.start = np.flatnonzero(edges == 1)
        self.end = np.flatnonzero(edges == -1)
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))

    def prefix(self) -> np.ndarray:
        """Hashes of all prefixes of the data, for hashes of any stretch of it."""
        return prefix_sums(self.data)

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        sums = self.prefix()
        return mixed((sums[self.end] - sums[self.start]) * powers(len(self.data), inverse=True)[self.start])

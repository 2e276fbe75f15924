"""Words of many texts at once, in numpy, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes, so that the arrays of
#: a slice stay a few dozen times this size whatever the batch holds.
SLICE_BYTES = 1 << 19

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def byte_class(chars: str, inverse: bool = False) -> np.ndarray:
    """Table of the bytes in ``chars`` (or, inverse, of all others)."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return ~table if inverse else table


#: Bytes of ``[^\x20\x09-\x0D]``.
PLAIN_WORD = byte_class(" \t\n\x0b\x0c\r", inverse=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A full avalanche over uint64 values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate(
                    [np.ones(1, np.uint64), np.full(n - 1, f & _MASK, np.uint64)]), dtype=np.uint64)
                    for f in (_P, _INV))


POWERS = Powers()


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit polynomial hashes of ``values[start:end]`` for many ranges."""
    POWERS.need(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * POWERS.up[:len(values)], out=sums[1:])
        return mix((sums[end] - sums[start]) * POWERS.down[start]
                   + (end - start).astype(np.uint64))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive runs of texts; a null text is empty.

    ``offsets`` has one entry more than the run has texts and starts at 0. A
    run holds at least one text, so a longer text is a run of its own.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, off_buf, data_buf = texts.buffers()
    offsets = np.frombuffer(off_buf, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray,
                is_word: np.ndarray = PLAIN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and each text's first word (one entry more)."""
    inside = is_word[data]
    fresh_text = np.zeros(len(data) + 1, bool)
    fresh_text[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | fresh_text[:-1]))
    end = np.flatnonzero(inside & (~after | fresh_text[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array with one list per part."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))

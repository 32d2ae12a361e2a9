"""Words of a batch of texts as numpy arrays: no Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", dtype=np.uint8))
_PRIME = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    up = down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            one = np.ones(1, dtype=np.uint64)
            cls.up = np.concatenate([one, np.multiply.accumulate(np.full(n, _PRIME, dtype=np.uint64))])
            cls.down = np.concatenate([one, np.multiply.accumulate(np.full(n, pow(_PRIME, -1, 1 << 64), dtype=np.uint64))])
        return cls.up, cls.down


def _hashes(d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: differences of a running polynomial sum, brought back to a common power."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        n = int(ends[end - 1]) - base
        up, down = _Powers.of(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((d[base:base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out


@dataclass
class Tokens:
    """Words of texts, in order: 64-bit hashes, row of the text, number of the line in it (from 0, by line feeds); and where each begins
    and ends in `data`, the bytes of all texts."""

    hashes: np.ndarray
    rows: np.ndarray
    lines: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def tokens(texts: pa.Array, lower: bool = False, lines: bool = True, closing: bytes = b"") -> Tokens:
    """Words between ASCII white space ([\\x20\\x09-\\x0D]); a null text has none. With `closing`, one such character at the end of a word
    is a word of its own if it comes after an ASCII letter or digit."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        none = np.zeros(0, dtype=np.int64)
        return Tokens(none.astype(np.uint64), none, none, none, none, none.astype(np.uint8))
    d = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    edges = offsets - offsets[0]
    if lower:
        d = _LOWER[d]
    word = ~_BLANK[d]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = edges[1:-1]
    inner = inner[(inner > 0) & (inner < len(d))]
    first[inner] = word[inner]  # a word ends with its text
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if closing:
        ends_so = np.isin(np.arange(256), np.frombuffer(closing, dtype=np.uint8))
        split = (ends - starts > 1) & ends_so[d[ends - 1]] & _ALNUM[d[ends - 2]]
        at = np.repeat(np.arange(len(starts)), 1 + split)
        second = np.concatenate([[False], at[1:] == at[:-1]])
        starts, ends, split = np.where(second, ends[at] - 1, starts[at]), ends[at], split[at]
        ends = np.where(split & ~second, ends - 1, ends)
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, edges)))
    number = np.zeros(0, dtype=np.int64)
    if lines:
        feeds = np.flatnonzero(d == 10)
        number = np.searchsorted(feeds, starts) - np.searchsorted(feeds, edges[:-1])[rows]
    return Tokens(_hashes(d, starts, ends), rows, number, starts, ends, d)


def blocks(batch: pa.RecordBatch, column: int = 1, most: int = 4 << 20):
    """A batch's rows in slices of about `most` bytes of text, so that arrays stay small whatever a batch holds; a longer text is
    a slice of its own."""
    texts = batch.column(column)
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end

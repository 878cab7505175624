"""Vectorised tokenising and hashing of Arrow string batches.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; since those bytes never occur inside a
multi-byte UTF-8 sequence, working on bytes and on code points gives the same words.  Nulls read as
empty texts.  Work is cut into pieces of a few MB so that memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ASCII_UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes.maketrans(_ASCII_UPPER, _ASCII_UPPER.lower())

#: Bytes that belong to a bare word: letters, digits and every byte of a multi-byte character.
BARE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold about ``limit`` bytes, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def raw(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of the texts, and where each text starts in them (one more entry than texts)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or data is None:
        return b"", np.zeros(len(texts) + 1, np.int64)
    return data.to_pybytes()[off[0] : off[-1]] if off[0] or off[-1] < data.size else data.to_pybytes(), off - off[0]


@dataclass
class Words:
    """The words of some texts: ``data[start[i]:end[i]]``; text d has words first[d] to first[d + 1]."""

    data: bytes
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: bytes, offsets: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """``inside``: which bytes make up words; by default all but white space."""
    buf = np.frombuffer(data, np.uint8)
    n = len(buf)
    kept = (~SPACE if inside is None else inside)[buf]
    before = np.empty(n, bool)
    before[1:] = kept[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[:-1] = kept[1:]
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    after[ends - 1] = False
    start = np.flatnonzero(kept & ~before)
    end = np.flatnonzero(kept & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words, in place."""
    x ^= x >> _S32
    x *= _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    size = end - start
    # Scrambled before any byte comes in, so that no byte can undo a difference in length.
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
    if not len(start):
        return h
    view = np.ndarray((len(data),), "<u8", buffer=data + bytes(8), strides=(1,))
    h ^= view[start] & _MASK[np.minimum(size, 8)]
    mix(h)
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest):
        left = size[rest] - at
        part = h[rest] * _M1 + np.uint64(at)
        part ^= view[start[rest] + at] & _MASK[np.minimum(left, 8)]
        h[rest] = mix(part)
        rest, at = rest[left > 8], at + 8
    return h


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hash(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of every ``size`` consecutive entries of h, scrambled."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, c in enumerate(odd_constants(size, seed)):
        out += h[k : k + n] * c
    return mix(out)

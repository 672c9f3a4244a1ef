"""Words and their hashes for a batch of texts, over the UTF-8 bytes and without a loop
per word. Work arrays are bounded by ``CHUNK`` bytes of text, however long a text is."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
LONG_WORD = 1 << 14
_U64 = np.uint64

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RANDOM = np.random.Generator(np.random.PCG64(7919))
_BYTE = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) | _U64(1)
_POWER = np.full(LONG_WORD, 0x9E3779B97F4A7C15, dtype=np.uint64)
_POWER[0] = 1
_POWER = np.cumprod(_POWER, dtype=np.uint64)
_STEP = _U64(0xD6E8FEB86659FD93)


@dataclass
class Texts:
    """Bytes of all texts of a batch end to end; text ``i`` is ``raw[off[i]:off[i + 1]]``."""

    raw: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are flagged."""
        return per_group(flags, self.off)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, dtype=np.int64)
    return Texts(raw[off[0] : off[-1]], off - off[0])


def per_group(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty groups give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


@dataclass
class Words:
    """Byte starts and lengths of the words, and where each text's words begin."""

    start: np.ndarray
    length: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words_of(t: Texts) -> Words:
    inside = ~SEPARATOR[t.raw]
    edge = np.zeros(len(t.raw) + 1, dtype=bool)
    edge[t.off] = True
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(start, end - start, np.searchsorted(start, t.off))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(33))


def word_hashes(t: Texts, w: Words) -> np.ndarray:
    """A 64-bit hash per word that depends on its bytes alone."""
    out = np.zeros(w.n, dtype=np.uint64)
    length = np.where(w.length >= LONG_WORD, 0, w.length)
    upto = np.concatenate([[0], np.cumsum(length)])
    a = 0
    while a < w.n:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, side="right")) - 1)
        n = length[a:b]
        begin = upto[a:b] - upto[a]
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        value = _BYTE[t.raw[np.repeat(w.start[a:b], n) + place]] * _POWER[place]
        some = np.flatnonzero(n)
        if len(some):
            out[a + some] = np.add.reduceat(value, begin[some])
        a = b
    out = mix(out + w.length.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(w.length >= LONG_WORD):
        word = t.raw[w.start[i] : w.start[i] + w.length[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of ``k`` consecutive words; entry ``i`` starts at word ``i``. Texts are not told
    apart: entries whose words run over the end of a text are for the caller to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = 0xD6E8FEB86659FD93 + 2 * salt * 0x9E3779B97F4A7C15 & 2**64 - 1 | 1
    # Spans double; the binary digits of k say which of them to join.
    out, length, span, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, length = span, size
            else:
                out = span[: len(span) - length] * _U64(pow(base, length, 2**64)) + out[size:]
                length += size
        if 2 * size > k:
            break
        span = span[:-size] * _U64(pow(base, size, 2**64)) + span[size:]
        size *= 2
    return mix(out[:n])


def inside_text(off: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the k-word windows lie in one text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return text[:n] == text[k - 1 :]


def slices(column: pa.Array, limit: int = 2 * CHUNK):
    """(first, end) row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    size = np.diff(texts_of(column).off)
    a = 0
    while a < len(size):
        upto = np.cumsum(size[a:])
        b = a + max(1, int(np.searchsorted(upto, limit, side="right")))
        yield a, b
        a = b

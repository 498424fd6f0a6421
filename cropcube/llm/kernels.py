"""Array kernels over the UTF-8 bytes of a batch of texts.

All work on a whole batch at a time: words, word fingerprints and shingles are found by array
operations on the batch's bytes, never by a loop over characters. Memory is a few dozen bytes for
each byte of a piece, and pieces are cut at PIECE bytes (a longer text is a piece of its own words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
PIECE = 2 << 20

#: Separators of the words of most contracts: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Word bytes of the decontamination contract: digits, letters, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("A") : ord("Z") + 1] = ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[0x80:] = True
NOT_SPACE = ~SPACE

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_STEP = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = -(-n >> 18) << 18  # the next multiple, so that few longer texts make it anew
        with np.errstate(over="ignore"):
            one = np.ones(1, np.uint64)
            _power = np.concatenate([one, np.cumprod(np.full(size, _BASE, np.uint64))])
            _inverse = np.concatenate([one, np.cumprod(np.full(size, _INVERSE, np.uint64))])
    return _power[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser); in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column on end, and the offset of each (one more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of documents of up to ``size`` bytes; a longer document is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every document (one more than documents)."""
    w = np.zeros(len(raw) + 1, bool)
    w[:-1] = is_word[raw]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    cut = np.zeros(len(w), bool)
    cut[offsets] = True
    starts = np.flatnonzero(w & (~before | cut))
    ends = np.flatnonzero(before & (~w | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit fingerprint of raw[start:end] for sorted, non-overlapping spans; A-Z as a-z if ``fold``."""
    out = np.empty(len(starts), np.uint64)
    table = _FOLDED if fold else _VALUE
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            a = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
            b = ends[j - 1]
            power, inverse = _powers(b - a + 1)
            s = np.zeros(b - a + 1, np.uint64)
            np.multiply(table[raw[a:b]], power[: b - a], out=s[1:])
            np.cumsum(s, out=s)
            x, y = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((s[y] - s[x]) * inverse[x] + (y - x).astype(np.uint64))
            i = j
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every k consecutive words of every document, and the first of every document.

    A document of fewer words, but not none, has one of all its words.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    count = np.diff(first)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for t in range(k):
            if t < n:
                h[: n - t] += words[t:] * _STEP[t % 16] + np.uint64(t)
        keep = np.ones(n, bool)
        for t in range(1, k):  # the last k-1 words of a document start no shingle
            at = first[1:] - t
            keep[at[(count >= t) & (at >= 0)]] = False
        short = np.flatnonzero((count > 0) & (count < k))
        for d in short:
            a, b = first[d], first[d + 1]
            keep[a] = True
            h[a] = np.uint64((b - a) << 56) + sum((words[a + t] * _STEP[t] for t in range(b - a)), np.uint64(0))
        out = mix(h[keep])
    per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return out, np.concatenate([[0], np.cumsum(per)])


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums from which any substring's fingerprint follows (``window_hash``); of bytes, or of words' fingerprints."""
    power, _ = _powers(len(raw) + 1)
    s = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply(_VALUE[raw] if raw.dtype == np.uint8 else raw, power[: len(raw)], out=s[1:])
        np.cumsum(s, out=s)
    return s


def window_hash(s: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Fingerprints of the ``size`` bytes from each position ``at`` (a slice or positions) under prefix sums ``s``."""
    _, inverse = _powers(len(s))
    with np.errstate(over="ignore"):
        if isinstance(at, slice):
            return mix((s[at.start + size : at.stop + size] - s[at]) * inverse[at])
        return mix((s[at + size] - s[at]) * inverse[at])


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences; equal planes compress to nothing."""
    if not len(values):
        return b""
    d = np.empty(len(values), np.uint64)
    d[0] = values[0]
    np.subtract(values[1:], values[:-1], out=d[1:])
    width = max(1, (int(d[1:].max()) if len(d) > 1 else 0).bit_length() + 7 >> 3)
    planes = np.ascontiguousarray(d[1:].view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + planes.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1)
    d = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    d[1:, :width] = planes.T
    out = d.reshape(-1).view(np.uint64)
    out[0] = int.from_bytes(blob[1:9], "little")
    with np.errstate(over="ignore"):
        return np.cumsum(out, dtype=np.uint64)

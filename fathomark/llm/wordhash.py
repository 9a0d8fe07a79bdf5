"""Words, runs of words and their 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time: a word of eight bytes stands for each.
PIECE = 2 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.array([b | 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, one blank after each, and where each starts; null is empty."""
    joined = b" ".join((t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()) + b" "
    lengths = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in column.to_pylist()]) if pa.types.is_null(column.type) else _lengths(column)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    return np.frombuffer(joined, dtype=np.uint8), starts.astype(np.int64)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def hash_words(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of bytes that are no white space. buf ends with white space."""
    white = WHITE[buf]
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    hashes = np.zeros(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        end = max(k + 1, int(np.searchsorted(starts, starts[k] + PIECE)))
        a, b = int(starts[k]), int(starts[end]) if end < len(starts) else len(buf)
        gaps = np.diff(np.append(starts[k:end], b))
        part = buf[a:b]
        value = _BYTE[LOWER[part] if lower else part]
        value[white[a:b]] = 0
        place = np.arange(b - a) - np.repeat(starts[k:end] - a, gaps)
        value *= powers(_BASE, int(gaps.max()))[place]
        hashes[k:end] = np.add.reduceat(value, starts[k:end] - a)
        k = end
    return starts, mix(hashes)


def hash_runs(buf: np.ndarray, starts: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to the next one, without those at the places of skip."""
    hashes = np.zeros(len(starts), dtype=np.uint64)
    ends = np.append(starts[1:], len(buf))
    k = 0
    while k < len(starts):
        end = max(k + 1, int(np.searchsorted(starts, starts[k] + PIECE)))
        a, b = int(starts[k]), int(ends[end - 1])
        value = _BYTE[buf[a:b]]
        value[skip[np.searchsorted(skip, a) : np.searchsorted(skip, b)] - a] = 0
        gaps = ends[k:end] - starts[k:end]
        value *= powers(_BASE, int(gaps.max()))[np.arange(b - a) - np.repeat(starts[k:end] - a, gaps)]
        hashes[k:end] = np.add.reduceat(value, starts[k:end] - a)
        k = end
    return mix(hashes)


def run_hashes(words: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of the runs of each length that start at each word; those that start too late are left out."""
    size = lambda n: max(0, len(words) - n + 1)
    power = powers(_STEP, max(lengths) + 1)
    doubled = {1: words}
    n = 1
    while 2 * n <= max(lengths):
        x = doubled[n]
        doubled[2 * n] = x[: size(2 * n)] + power[n] * x[n : n + size(2 * n)]
        n *= 2
    out = {}
    for length in lengths:
        total, done = np.zeros(size(length), dtype=np.uint64), 0
        for n in sorted(doubled, reverse=True):
            if length & n:
                total = total + power[done] * doubled[n][done : done + size(length)]
                done += n
        out[length] = mix(total + np.uint64(length))
    return out

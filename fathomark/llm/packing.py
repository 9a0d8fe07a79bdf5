"""Arrays and rows as bytes: what goes through a shuffle is few large blobs, not many small rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def squeeze(values: np.ndarray, dtype: str) -> bytes:
    """Integers by byte planes, compressed; for small or slowly growing numbers."""
    planes = np.ascontiguousarray(np.asarray(values).astype(dtype).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def cut_bytes(values: np.ndarray, n: int) -> bytes:
    """The low n bytes of each unsigned 64-bit integer."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def uncut_bytes(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :n] = low
    return out.view("<u8").reshape(-1)


def join_parts(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def split_parts(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    at, out = 4 * (n + 1), []
    for length in struct.unpack_from(f"<{n}I", data, 4):
        out.append(data[at : at + length])
        at += length
    return out


def pack_places(doc: np.ndarray, place: np.ndarray) -> bytes:
    """Pairs in ascending order (doc signed 64-bit, place below 2**32)."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
    ids, counts = doc[first], np.diff(np.append(first, len(doc)))
    step = np.diff(place.astype(np.int64), prepend=0)
    step[first] = place[first]
    return join_parts([squeeze(np.diff(ids.astype(np.int64), prepend=0), "<i8"), squeeze(counts, "<u4"), squeeze(step, "<u4")])


def unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, counts, step = split_parts(data)
    ids, counts, step = np.cumsum(unsqueeze(ids, "<i8")), unsqueeze(counts, "<u4").astype(np.int64), unsqueeze(step, "<u4").astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    base = total[first] - step[first] if len(first) else total
    return np.repeat(ids, counts), total - np.repeat(base, counts)


def rows_to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def bytes_to_rows(data: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(data)


def parts_by(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each key below n that occurs, with the indices of its rows in order."""
    order = np.argsort(key, kind="stable")
    at = np.searchsorted(key[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), order[at[k] : at[k + 1]]


def sized_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes; a row is never split."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            n = batch.num_rows if batch.nbytes + size <= limit else max(1, min(batch.num_rows, int(batch.num_rows * (limit - size) / max(1, batch.nbytes))))
            part, batch = batch.slice(0, n), batch.slice(n)
            held.append(part)
            size += part.nbytes
            if size >= limit or batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

"""Token-id output: ids packed in the fewest bits that hold the vocabulary.

A shard file is a run of blocks, then a footer; all numbers are little-endian.

    payload   block after block; each packs block_ids ids, bit k of id j at bit j*bits+k,
              padded to a whole byte
    footer    int64 doc_id[n_docs], uint8 known[n_docs] (0: the id is null),
              uint64 doc_start[n_docs + 1] (in ids), uint64 block_at[n_blocks + 1] (in bytes)
    tail      uint32 bits, uint32 block_ids, uint64 n_docs, uint64 n_blocks, 8 bytes magic

Any id is found from its number alone: its block is number // block_ids, so a reader fetches
the tail, the footer and just the blocks that it needs.

Documents go to shards by ranges of doc_id, so the shards in order hold them in ascending
order (null ids first, rows of one id by text). There are as many shards as the session has shuffle partitions, and more
for tables of more text than SHARD_BYTES for each, so that a shard doesn't grow with the table. Shards
are written by the executors under
the shared folder, each to a name of its own attempt and then renamed, so that a repeated
task leaves the same file. Special tokens that a text spells out are special tokens, as in the library, or
ordinary text with ``special_as_text``.

Edge cases: a null or empty text gives the end id alone; repeated rows are written once for each; rows alike in
id and text are ties in the order, which changes nothing in the files; a very long text is encoded whole, its ids go to blocks as any; no documents give no
shards and no rows; all columns but the id and the text are dropped, so that none can clash with the result's.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.llm.common import scratch
from fathomark.llm.packing import sized_batches
from fathomark.llm.wordhash import hash_runs, text_bytes

MAGIC = b"FMTOKEN1"
TAIL = struct.Struct("<IIQQ8s")
BLOCK_IDS = 1 << 16
#: Units whose ids a worker keeps; beyond it the store starts anew.
CACHE_UNITS = 1_000_000
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 256 << 20

#: White space other than the plain space and the line feed; with it, a text is encoded whole.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
# The pre-tokenizer never joins a character to white space after it, so other texts fall into units
# that are encoded independently: spaces and line feeds, and what follows up to the next of them.


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Ids of texts by the tokenizers library.

    The units of a batch are told apart by 64-bit hashes of their bytes, all at once; each different
    unit is encoded by the library when it is first met, and its ids are kept in a bounded store.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.vocabulary = self.tokenizer.get_vocab_size()
        # a byte-level token has a character for each byte
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.vocabulary)])
        self.special = () if special_as_text else [str(t) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.number: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.begin, self.length = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after another, and how many of each.

        Units that begin with a blank and don't end with one are encoded as one text: it falls into
        them again, and the tokens' lengths in bytes tell where each one ends.
        """
        joined = [i for i, u in enumerate(units) if u[0] in b" \n" and u[-1] not in b" \n"]
        counts, parts = np.zeros(len(units), dtype=np.int64), [None] * len(units)
        for at in range(0, len(joined), 20_000):
            own = joined[at : at + 20_000]
            ids = np.array(self._ask([b"".join(units[i] for i in own).decode("utf-8", "surrogatepass")])[0], dtype=np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(units[i]) for i in own])) + 1
            for i, a, b in zip(own, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                parts[i] = ids[a:b]
        apart = [i for i, p in enumerate(parts) if p is None]
        for i, ids in zip(apart, self._ask([units[i].decode("utf-8", "surrogatepass") for i in apart]), strict=True):
            parts[i] = np.array(ids, dtype=np.uint32)
        counts[:] = [len(p) for p in parts]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), counts

    def _keep(self, hashes: list[int], units: list[bytes]) -> None:
        flat, n = self._units(units)
        first = len(self.number)
        self.number.update(zip(hashes, range(first, first + len(n)), strict=True))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while first + len(n) > len(self.begin):
            self.begin, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.length))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.length[first : first + len(n)] = n
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        values = texts.to_pylist()
        whole = [i for i, t in enumerate(values) if t and (_ODD.search(t) or any(s in t for s in self.special))]
        if whole:
            at = set(whole)
            texts = pa.array([None if i in at else t for i, t in enumerate(values)], pa.string())
        buf, begin = text_bytes(texts)
        end = np.append(begin[1:], len(buf)) - 1  # where the blank after each text stands
        blank = (buf == 0x20) | (buf == 0x0A)
        opens = np.zeros(len(buf), dtype=bool)
        opens[1:] = blank[1:] & ~blank[:-1]
        opens[end] = False
        opens[begin[begin < end]] = True
        starts = np.flatnonzero(opens)
        out = [np.zeros(0, dtype=np.uint32) for _ in values]
        if len(starts):
            out = self._by_units(buf, begin, end, starts)
        for i, own in zip(whole, self._ask([values[i] for i in whole]), strict=True):
            out[i] = np.array(own, dtype=np.uint32)
        return out

    def _by_units(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        hashes = hash_runs(buf, starts, end)
        distinct, where, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.number) + len(distinct) > CACHE_UNITS:
            self._empty()
        keys = distinct.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.number]
        stops = np.append(starts[1:], len(buf))
        stops = np.minimum(stops, end[np.searchsorted(begin, starts, side="right") - 1])
        data = buf.tobytes()
        self._keep([keys[k] for k in new], [data[a:b] for a, b in zip(starts[where[new]].tolist(), stops[where[new]].tolist(), strict=True)])
        unit = np.fromiter(map(self.number.__getitem__, keys), dtype=np.int64, count=len(keys))[of]
        n = self.length[unit]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.begin[unit] - total[:-1], n)]
        cut = total[np.searchsorted(starts, np.append(begin, len(buf)))]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    key = (path, special_as_text)
    return _encoders.get(key) or _encoders.setdefault(key, Encoder(*key))


class ShardWriter:
    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.rest, self.n_rest, self.at = [], 0, [0]
        self.docs, self.known, self.starts = array("q"), bytearray(), array("q", [0])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block_ids:
            ids = np.concatenate(self.rest)
            whole = len(ids) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(ids[k : k + self.block_ids])
            self.rest, self.n_rest = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at.append(self.at[-1] + len(data))

    def close(self) -> None:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        self.out.write(np.array(self.docs, dtype="<i8").tobytes() + bytes(self.known))
        self.out.write(np.array(self.starts, dtype="<u8").tobytes() + np.array(self.at, dtype="<u8").tobytes())
        self.out.write(TAIL.pack(self.bits, self.block_ids, len(self.docs), len(self.at) - 1, MAGIC))


class ShardReader:
    """Random access to a shard by number of id or of document."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(size - TAIL.size)
        self.bits, self.block_ids, self.n_docs, self.n_blocks, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        length = 17 * self.n_docs + 8 * (self.n_blocks + 2)
        file.seek(size - TAIL.size - length)
        data = file.read(length)
        a, b, c = 8 * self.n_docs, 9 * self.n_docs, 17 * self.n_docs + 8
        self.doc_ids, known = np.frombuffer(data[:a], "<i8"), np.frombuffer(data[a:b], np.uint8)
        self.known, self.starts, self.at = known.astype(bool), np.frombuffer(data[b:c], "<u8").astype(np.int64), np.frombuffer(data[c:], "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block_ids, -(-end // self.block_ids)
        self.file.seek(int(self.at[first]))
        data = self.file.read(int(self.at[last] - self.at[first]))
        n = [min(self.block_ids, int(self.starts[-1]) - k * self.block_ids) for k in range(first, last)]
        parts = [unpack(data[self.at[first + k] - self.at[first] : self.at[first + k + 1] - self.at[first]], self.bits, m) for k, m in enumerate(n)]
        ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return ids[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order, a few blocks at a time."""
        k = 0
        while k < self.n_docs:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + 16 * self.block_ids)) - 1)
            end = min(end, self.n_docs)
            ids, base = self.ids(int(self.starts[k]), int(self.starts[end])), int(self.starts[k])
            for j in range(k, end):
                yield int(self.doc_ids[j]) if self.known[j] else None, int(self.starts[j]), ids[self.starts[j] - base : self.starts[j + 1] - base]
            k = end


MANIFEST = "shard int, path string, n_docs long, n_ids long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, special_as_text: bool = False) -> list[tuple[int, str, int, int]]:
    """Encode docs and write shards below path; gives the manifest, a row for each shard: number, path, documents, ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the planner's estimate (files are compressed) tells whether there can be more text than that many shards should hold
    if not shards and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * 8 > n * SHARD_BYTES:
        n = max(n, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, task = encoder(tokenizer, special_as_text), None, TaskContext.get()
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        name, own = f"{base}/{task.partitionId():06d}.tokens", f"{base}/.{uuid.uuid4().hex}"
        for batch in sized_batches(batches, CHUNK_BYTES):
            for d, row in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(own)
                    writer = ShardWriter(out, bits_for(max(enc.vocabulary, end_id + 1)))
                writer.add(d, np.append(row, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]]})

    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(tuple(r) for r in rows.mapInArrow(write, MANIFEST).collect())


def read_tokens(spark: SparkSession, path: str, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """A row for each document, from the shard files: doc_id, start, n_tokens, ids_crc32."""
    begin, rows = 0, []
    for _, name, _, n_ids in manifest:
        rows.append((name, begin))
        begin += n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(name) as file:
                    found = [(d, start + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in ShardReader(file, file.size()).documents()]
                for k in range(0, len(found), 10_000):
                    part = list(zip(*found[k : k + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(rows, "path string, start long")
    return (shards.repartition(max(1, len(rows))) if rows else shards).mapInArrow(read, ENTRIES)


def token_output(docs: DataFrame, tokenizer: str, *, end_id: int, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    return read_tokens(spark, path, write_tokens(docs, path, tokenizer, end_id=end_id))

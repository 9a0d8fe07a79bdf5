"""Benchmark decontamination: one Aho-Corasick automaton over all items, scanned once by each document.

Items and documents are normalised alike (A-Z lowered, words joined by one space). A window is
``window`` consecutive item words, or the whole item where it has fewer. Whatever holds a window
holds one of the item's blocks of half as many words (those that start at a multiple of that), so
the automaton has the blocks, and the short items whole, and its size is that of the items' text and not of all
windows. At each block that a document has, the windows around it are looked up. Every match is mapped to word
numbers and, for the spans, to code points of the original text.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item is
no window; items with a null id count as one item, which is named in no list; repeated items and
items that share windows are all reported, in the order of their ids; very long texts are scanned whole,
one at a time; repeated rows are scanned each by itself; empty tables of documents or items are nothing special; other
columns of ``docs`` are kept, but for those named like an output column, which are replaced. The
automaton is bounded: items beyond ``block_bytes`` of text (of which each takes some 80 bytes of a worker's memory) go to
further automata, each scanning in its own pass that adds to what the earlier ones have found; tasks read
their items from the shared folder then, and the driver holds none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomark.llm.common import scratch
from fathomark.llm.packing import sized_batches

WINDOW = 10
BLOCK_BYTES = 4 << 20
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO = bytes((b | 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES or 0x41 <= b <= 0x5A else 32 for b in range(256))
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
_CARRIED = T.StructType([T.StructField("_from", T.ArrayType(T.IntegerType())), T.StructField("_to", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))])


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TO).split()


class Windows:
    """Windows with their items, and the automaton of blocks (value 0) and short items (value: number of words)."""

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int) -> None:
        self.window, self.half = window, (window + 1) // 2
        by: dict[bytes, set[str | None]] = {}
        self.automaton = ahocorasick.Automaton()
        for item, text in items:
            words = words_of(text)
            n = min(window, len(words))
            for i in range(len(words) - n + 1) if n else ():
                by.setdefault(b" ".join(words[i : i + n]), set()).add(item)
            for i in range(0, len(words) - self.half + 1, self.half) if n == window else ((0,) if n else ()):
                self.automaton.add_word(_padded(words[i : i + (self.half if n == window else n)]), 0)
        self.items = {k: frozenset(v) for k, v in by.items()}
        # a short item may be a block of another one, too
        for key in self.items:
            if (n := key.count(b" ") + 1) < window:
                self.automaton.add_word(_padded([key]), n)
        if by:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str | None]]:
        """First words, ends and items of all windows in words."""
        none = np.zeros(0, dtype=np.int32)
        if not self.items or not words:
            return none, none, set()
        line = _padded(words)
        found = list(self.automaton.iter(line))
        if not found:
            return none, none, set()
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        end = np.searchsorted(spaces, np.fromiter((e for e, _ in found), dtype=np.int64, count=len(found)))
        n = np.fromiter((v for _, v in found), dtype=np.int64, count=len(found))
        start, stop, items = [], [], set()
        for e, k in zip(end[n > 0].tolist(), n[n > 0].tolist(), strict=True):
            start.append(e - k)
            stop.append(e)
            items |= self.items[b" ".join(words[e - k : e])]
        # every end of a block of half the words, that of a short item as well
        ends = end[(n == 0) | (n == self.half)]
        around = np.unique(ends[:, None] - np.arange(self.half, self.window + 1))
        for i in around[(around >= 0) & (around <= len(words) - self.window)].tolist():
            own = self.items.get(b" ".join(words[i : i + self.window]))
            if own:
                start.append(i)
                stop.append(i + self.window)
                items |= own
        return np.array(start, dtype=np.int32), np.array(stop, dtype=np.int32), items


def _padded(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def union(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of their union, as starts and ends."""
    depth = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], depth, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


_built: dict[tuple, Windows] = {}


def _windows(items: tuple | str, window: int) -> Windows:
    """items: the items, or the folder that holds them."""
    key = (items if isinstance(items, str) else hash(items), window)
    if key not in _built:
        _built.clear()
        _built[key] = Windows(_read(items) if isinstance(items, str) else items, window)
    return _built[key]


def _read(folder: str) -> Iterator[tuple[str | None, str]]:
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    for batch in pyarrow.dataset.dataset(base, filesystem=fs, format="parquet", schema=pa.schema([("i", pa.string()), ("t", pa.string())])).to_batches():
        yield from zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True)


def _pass(items: tuple | str, window: int, column: str, first: bool, last: bool, schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(items, window)
        for batch in sized_batches(batches, 4 << 20):
            out: dict[str, list] = {f.name: [] for f in schema if f.name in (*FOUND.names, *_CARRIED.names)}
            carried = [[None] * batch.num_rows] * 3 if first else [batch.column(c).to_pylist() for c in _CARRIED.names]
            for text, a, b, ids in zip(batch.column(column).to_pylist(), *carried, strict=True):
                words = words_of(text)
                start, end, items_ = windows.scan(words)
                if not first:
                    start, end, items_ = np.concatenate((start, np.array(a, np.int32))), np.concatenate((end, np.array(b, np.int32))), items_ | set(ids)
                if len(start):
                    start, end = union(start, end, len(words))
                if not last:
                    for c, v in zip(_CARRIED.names, (start.tolist(), end.tolist(), list(items_)), strict=True):
                        out[c].append(v)
                    continue
                ids = sorted(i for i in items_ if i is not None)
                spans = []
                if len(start):
                    at = [m.span() for m in _ORIGINAL.finditer(text)]
                    spans = [{"start": at[s][0], "end": at[e - 1][1]} for s, e in zip(start, end, strict=True)]
                row = (len(words), int((end - start).sum()), len(items_), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(len(start)), ids, spans)
                for c, v in zip(FOUND.names, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if f.name in out else batch.column(f.name) for f in schema], schema=schema)

    return scan


def item_blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> list[tuple | str]:
    """The items, where they fit one block, or else the folders of parts of about block_bytes."""
    kept = items.select(F.col(f"`{id_column}`").cast("string").alias("i"), F.col(f"`{text_column}`").alias("t")).where("t is not null").distinct()
    total = kept.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= block_bytes:
        return [tuple(sorted(((r.i, r.t) for r in kept.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1])))]
    n = -(-total // block_bytes)
    folder = scratch(items.sparkSession, "items")
    parts = kept.withColumn("b", F.expr(f"pmod(xxhash64(coalesce(i, ''), t), {n})").cast("int")).repartition(n, "b")
    parts.write.partitionBy("b").parquet(folder)
    return [f"{folder}/b={r.b}" for r in parts.select("b").distinct().orderBy("b").collect()]


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of docs with the columns of FOUND: how many words stand in an occurrence of an item window, of which items, and where."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in docs.schema if f.name not in (*FOUND.names, *_CARRIED.names)]
    df = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    for k, block in enumerate(blocks):
        first, last = k == 0, k == len(blocks) - 1
        schema = T.StructType([*kept, *(FOUND if last else _CARRIED)])
        df = df.mapInArrow(_pass(block, window, text, first, last, to_arrow_schema(schema)), schema)
    return df

"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at a word that has ``window`` words of its document from it on. The suffix tree of
all documents, down to the depth of ``window`` words, is cut into subtrees that fit in memory:

1. count   How many suffixes start with each prefix of 1, 2, 4, 8, 16 and ``window`` words,
           by class of the prefix's hash: tables of fixed size, summed over all documents by a tree of tasks.
2. split   A class of one-word prefixes with few enough suffixes is a group; the others are
           lengthened to two words, and so on. Groups are dealt to partitions, the largest
           first; a partition that has more suffixes than memory should hold builds them in
           turns, each of the full-length prefixes of one share of the hash.
3. build   Suffixes have order-preserving labels: the hash of the first word, then that of the first
           two, and so on to the whole window. Sorted by label they are the leaves of a tree, and
           the labels' common prefix with the next leaf gives the depths of its internal nodes
           (``SuffixTree``). An internal node at the depth of the window is a word sequence
           that occurs more than once; its first leaf, by document and place, stays, and
           the others are repeats. Each task builds the tree of its own chunk of documents
           first and sends a repeated sequence's first leaf only, so that a passage of a third
           of all documents is met once for each chunk; repeats that the chunk knows go to
           their documents at once, through the partition of the document and not of the sequence.
4. remove  Repeats of a document, put end to end, are its maximal repeats: stretches of which every
           window repeats, and that no word on either side lengthens. They go back to their
           documents, which are read once more, by document key.

Sequences are compared by labels of ``label_bytes`` bytes, of which the last four (of seven) tell sequences
with the same first sixteen words apart; two different ones that differ earlier agree by chance once in 2**56.
Suffixes and documents travel as compressed blobs, not as rows.

Edge cases: a null text has no words; fewer words than the window give no window; rows alike in
id and text are one document and get the same result; rows of one id and different texts, and
null ids, are ordered by id, then text; a very long text is one document in memory, its suffixes spread over
partitions as all others; other columns are kept, except those named like an
output column, which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomark.llm.common import SLICES, slices_summed
from fathomark.llm.packing import bytes_to_rows, cut_bytes, join_parts, pack_places, parts_by, rows_to_bytes, sized_batches, split_parts, squeeze, uncut_bytes, unpack_places
from fathomark.llm.rows import KEY, keyed
from fathomark.llm.wordhash import hash_words, mix, run_hashes, text_bytes

WINDOW = 20
#: Text bytes in a chunk, and suffixes that a partition's subtrees hold.
CHUNK_BYTES = 4 << 20
SUFFIXES = 1_500_000
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
SPANS = T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
_BLOB = "part int, kind int, data binary"
#: Classes of prefixes that are counted, by depth; with up to some 100,000 partitions each has several.
CLASS_BITS = 18
#: Bits of a label for each depth but the last; the first word has twice as many.
LEVEL_BITS = 4
PARTITIONS = 100_000
#: What a task reads at least, to tell how many tables of counts there are.
TASK_BYTES = 32 << 20


def depths_for(window: int) -> tuple[int, ...]:
    return (*(1 << k for k in range(window.bit_length()) if 1 << k < window), window)


def label_cuts(levels: int) -> list[int]:
    """How many bits of a label stand for the first 1, 2, ... levels; the last takes all that are left."""
    return [LEVEL_BITS * (k + 2) for k in range(levels - 1)] + [64]


def labels_of(hashes: dict[int, np.ndarray]) -> np.ndarray:
    """Of each suffix: the leading bits of the hashes of its prefixes, the shortest first."""
    out, done = None, 0
    for d, cut in zip(sorted(hashes), label_cuts(len(hashes)), strict=True):
        bits = hashes[d] >> np.uint64(64 - (cut - done)) << np.uint64(64 - cut)
        out = bits if out is None else out | bits
        done = cut
    return out


class SuffixTree:
    """The tree of suffixes with these labels: leaves in order, and for each but the last the levels that it shares with the next."""

    def __init__(self, labels: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.leaves = np.argsort(labels, kind="stable")
        ordered = labels[self.leaves]
        differ = ordered[1:] ^ ordered[:-1]
        self.shared = np.zeros(len(differ), dtype=np.int8)
        for cut in label_cuts(levels):
            self.shared += (differ == 0) if cut == 64 else (differ >> np.uint64(64 - cut) == 0)

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf of each internal node at a level (from 1): leaves that share so many levels, and some no more."""
        same = np.concatenate(([False], self.shared >= level, [False])).astype(np.int8)
        edge = np.diff(same)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first) and level < self.levels:
            upto = np.concatenate(([0], np.cumsum(self.shared == level)))
            branches = upto[last] > upto[first]
            first, last = first[branches], last[branches]
        return first, last

    def repeats(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The leaves of the deepest nodes but for the first of each by document and place."""
        first, last = self.nodes(self.levels)
        n = last - first + 1
        if not len(n):
            return np.zeros(0, dtype=np.int64)
        node = np.repeat(np.arange(len(n)), n)
        leaves = self.leaves[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
        leaves = leaves[np.lexsort((place[leaves], doc[leaves], node))]
        # a suffix given twice is the first one, too
        earliest = np.repeat(leaves[np.cumsum(n) - n], n)
        return leaves[(doc[leaves] != doc[earliest]) | (place[leaves] != place[earliest])]


def suffixes(batch: pa.RecordBatch, text: str, window: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Row in the batch, place in its text, and hashes of the prefixes of each depth, for all suffixes in order."""
    buf, begin = text_bytes(batch.column(text))
    starts, words = hash_words(buf)
    row = np.searchsorted(begin, starts, side="right") - 1
    first = np.searchsorted(row, np.arange(batch.num_rows))
    end = np.append(first[1:], len(words))
    at = np.arange(len(words))
    has = np.flatnonzero(at + window <= end[row])
    hashes = run_hashes(words, depths_for(window))
    return row[has], has - first[row[has]], {d: h[has] for d, h in hashes.items()}


def _count(text: str, window: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths = depths_for(window)
        total = np.zeros((len(depths), 1 << bits), dtype=np.int64)
        for batch in sized_batches(batches, CHUNK_BYTES):
            hashes = suffixes(batch, text, window)[2]
            for k, d in enumerate(depths):
                total[k] += np.bincount((hashes[d] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            yield _blob_batch([(k * SLICES + j, 0, squeeze(x, "<i8")) for k, depth in enumerate(total) for j, x in enumerate(np.split(depth, SLICES))])

    return count


def split_tree(counts: np.ndarray, partitions: int) -> np.ndarray:
    """For each depth and class the partition of its subtree, or -1 where prefixes are lengthened."""
    total = int(counts[0].sum())
    cap = max(1, total // (8 * partitions))
    table = np.full(counts.shape, -1, dtype=np.int32)
    groups, left = [], 1.0
    for depth in range(len(counts)):
        last = depth == len(counts) - 1
        here = np.flatnonzero((counts[depth] > 0) & ((counts[depth] <= cap) | last))
        groups += [(-float(counts[depth][c]) * left, depth, int(c)) for c in here]
        left *= 1 - counts[depth][here].sum() / max(1, total)
        empty = counts[depth] == 0
        table[depth][empty] = np.flatnonzero(empty) % partitions
    loads = [(0.0, p) for p in range(partitions)]
    for weight, depth, c in sorted(groups):
        load, p = heapq.heappop(loads)
        table[depth][c] = p
        heapq.heappush(loads, (load - weight, p))
    return table


def _route(hashes: dict[int, np.ndarray], table: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - (table.shape[1].bit_length() - 1))
    part = np.full(len(next(iter(hashes.values()))), -1, dtype=np.int32)
    for k, d in enumerate(sorted(hashes)):
        open_ = np.flatnonzero(part < 0)
        part[open_] = table[k][(hashes[d][open_] >> shift).astype(np.int64)]
    return part


def _blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def _emit(text: str, window: int, table: np.ndarray, label_bytes: int, turns: int, documents: int):
    """Leaves for the subtrees (kind: the turn), and repeats that the chunk knows, by document (kind -1)."""
    partitions, levels = int(table.max()) + 1, len(depths_for(window))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, CHUNK_BYTES):
            # rows that share a key are one document: each place is sent once, in ascending order
            batch = batch.take(pa.array(np.unique(batch.column(KEY).to_numpy(), return_index=True)[1]))
            row, place, hashes = suffixes(batch, text, window)
            doc, label = batch.column(KEY).to_numpy()[row], labels_of(hashes)
            part = _route(hashes, table).astype(np.int64) * turns
            if turns > 1:
                part += (mix(hashes[window]) % np.uint64(turns)).astype(np.int64)
            del hashes
            new = np.ones(len(label), dtype=bool)
            new[SuffixTree(label, levels).repeats(doc, place)] = False
            known, new = np.flatnonzero(~new), np.flatnonzero(new)
            for p, own in parts_by(part[new], partitions * turns):
                own = new[own]
                yield _blob_batch([(p // turns, p % turns, join_parts([pack_places(doc[own], place[own]), cut_bytes(label[own] >> np.uint64(64 - 8 * label_bytes), label_bytes)]))])
            for p, own in parts_by(bucket(doc[known], documents), documents):
                yield _blob_batch([(p, -1, pack_places(doc[known[own]], place[known[own]]))])

    return emit


def _build(window: int, documents: int, label_bytes: int):
    levels = len(depths_for(window))

    def subtree(doc: list[np.ndarray], place: list[np.ndarray], label: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if doc:
            doc, place, label = np.concatenate(doc), np.concatenate(place), np.concatenate(label)
            again = SuffixTree(label << np.uint64(64 - 8 * label_bytes), levels).repeats(doc, place)
            doc, place = doc[again], place[again].astype(np.int64)
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            for p, own in parts_by(bucket(doc, documents), documents):
                yield _blob_batch([(p, 0, pack_places(doc[own], place[own]))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, place, label, turn = [], [], [], None
        for batch in batches:
            for part, kind, data in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind < 0:
                    yield _blob_batch([(part, 0, data)])
                    continue
                if kind != turn:
                    yield from subtree(doc, place, label)
                    doc, place, label, turn = [], [], [], kind
                places, labels = split_parts(data)
                d, q = unpack_places(places)
                doc.append(d)
                place.append(q.astype(np.uint32))
                label.append(uncut_bytes(labels, label_bytes))
        yield from subtree(doc, place, label)

    return build


def bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int32)


def documents_by_key(n: int, kind: int = 1):
    """Whole rows in blobs by the bucket of their key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, 2 * CHUNK_BYTES):
            for p, own in parts_by(bucket(batch.column(KEY).to_numpy(), n), n):
                yield _blob_batch([(p, kind, rows_to_bytes(batch.take(pa.array(own))))])

    return pack


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def _remove(text: str, window: int, schema: pa.Schema, kept_text: str | None):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        doc = place = None
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind == 0:
                    found.append(unpack_places(data))
                    continue
                if doc is None:
                    doc = np.concatenate([d for d, _ in found]) if found else np.zeros(0, dtype=np.int64)
                    place = np.concatenate([q for _, q in found]) if found else np.zeros(0, dtype=np.int64)
                    order = np.argsort(doc, kind="stable")
                    doc, place = doc[order], place[order]
                    found.clear()
                for rows in bytes_to_rows(data):
                    yield _judged(rows, doc, place)

    def _judged(rows: pa.RecordBatch, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        keys = rows.column(KEY).to_numpy()
        lo, hi = np.searchsorted(doc, keys, side="left"), np.searchsorted(doc, keys, side="right")
        out: dict[str, list] = {name: [] for name in (*FOUND.names, SPANS.name, "_kept")}
        for t, a, b in zip(rows.column(text).to_pylist(), lo, hi, strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            gone, spans, n = None, [], len(words)
            if b > a:
                gone = covered(place[a:b], window, n)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                words = list(itertools.compress(words, ~gone))
            kept = b" ".join(words)
            for c, v in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), spans, t if gone is None else kept.decode("utf-8", "surrogatepass")), strict=True):
                out[c].append(v)
        source = lambda f: out["_kept"] if f.name == kept_text else out.get(f.name)
        return pa.RecordBatch.from_arrays([rows.column(f.name) if source(f) is None else pa.array(source(f), type=f.type) for f in schema], schema=schema)

    return remove


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, replace: bool = False, label_bytes: int = 7, suffixes_each: int = SUFFIXES) -> DataFrame:
    """All rows of docs with the columns of FOUND and SPANS (the maximal repeats, as spans of words, which are removed). replace: text becomes the kept words, where any was removed."""
    spark = docs.sparkSession
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (*FOUND.names, SPANS.name, KEY)))
    rows = keyed(docs, doc_id, text)
    own = rows.select(KEY, F.col(f"`{text}`").alias("text"))

    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    depths, bits = depths_for(window), min(CLASS_BITS, max(12, (size // 100_000).bit_length()))
    counts = slices_summed(own.mapInArrow(_count("text", window, bits), _BLOB), len(depths) * SLICES, 1 << bits, tasks=size // TASK_BYTES).reshape(len(depths), -1)

    suffixes_ = int(counts[0].sum())
    n = min(PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes_ // suffixes_each)))
    turns = max(1, -(-suffixes_ // (n * suffixes_each)))
    table = split_tree(counts, n)
    leaves = own.mapInArrow(_emit("text", window, table, label_bytes, turns, n), _BLOB).repartitionById(n, "part")
    leaves = leaves.sortWithinPartitions("kind") if turns > 1 else leaves
    repeats = leaves.mapInArrow(_build(window, n, label_bytes), _BLOB)
    texts = rows.mapInArrow(documents_by_key(n), _BLOB)
    both = repeats.unionByName(texts).repartitionById(n, "part").sortWithinPartitions("kind")
    schema = T.StructType([*docs.schema, *FOUND, SPANS])
    return both.mapInArrow(_remove(text, window, to_arrow_schema(schema), text if replace else None), schema)

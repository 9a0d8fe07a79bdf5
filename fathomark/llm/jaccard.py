"""Exact Jaccard join of word n-gram sets, by prefixes of token combinations.

Tokens are 64-bit hashes of shingles, ordered by how often their class (the top bits of the
hash, counted over all documents) occurs, rare ones first.

1. sets      Every document's set becomes a fingerprint; documents of one set are a class, and
             only its smallest member goes on.
2. prefixes  Two sets that link share a token among the first n - ceil(t n) + 1 of each. Where it is a rare
             one, the set is found by it. Where it is frequent, so are all that they share, and two of them
             that are neighbours in both sets stand among the first 2 (1 - t) n + 2 of each: each token that is in one set
             alone comes between no more than two shared ones, and there are too few of those. So a
             set is indexed by the rare tokens of its prefix, and by the pairs of neighbouring
             frequent ones of the extended prefix; entries grow with the size of a set, not with its square.
3. stars     The sets found at one index entry with sizes that can link name the smallest of
             them their leader. Entries give pairs (leader, member), never all pairs.
4. verify    A leader and its members meet at one task, first by the histograms of their sets over
             a few classes, which bound the overlap of any two from above: a member that can
             link with none of the others goes. Whole sets are sent for those left: a set is
             compared with all that it isn't connected to yet, until no two unconnected sets
             are left uncompared. Sets that share an entry share its leader, so no link is
             lost. Members of more tokens than a task should hold are split into blocks, each
             with the leader; those that are connected to it then need not be compared with each other any more, and
             only the others, again in blocks, meet all members.
5. connect   Components of the links found, by alternating stars.

Figures for blocks: a block is half of ``tokens_each``, some 5000 texts of 400 words. Members that the leader reaches are sent once,
however many blocks they fill; if u blocks of members are left that it doesn't reach, all g blocks are sent u times. So near
copies of one text cost in proportion to their number, and only a leader of many sets that are not alike costs g times u.
Sets that the histograms rule out, and exact copies, are not among them.

Edge cases: a text with fewer words than a shingle is one shingle; a very long text is one set in memory; null and wordless texts have
empty sets and link with nothing; rows alike in id and text are one document; null ids, and
rows of one id with different texts, are told apart by a key in the order of id and text,
and a component is named by the id of its smallest key; other columns are kept, except those
named like an output column, which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomark.llm.common import SLICES, slices_summed, small_batches, written
from fathomark.llm.components import components
from fathomark.llm.packing import bytes_to_rows, join_parts, parts_by, sized_batches, split_parts, squeeze, unsqueeze
from fathomark.llm.rows import KEY, keyed
from fathomark.llm.substrings import _BLOB, _blob_batch, bucket, documents_by_key
from fathomark.llm.wordhash import hash_words, mix, run_hashes, text_bytes

SHINGLE = 3
PERCENT = 90
CLASS_BITS = 22
CHUNK_BYTES = 4 << 20
#: A class is frequent from this many times the mean of all classes on, or of FLOOR.
FREQUENT, FLOOR = 8, 64
#: A key of more rows than LEAST_HOT and than one in HOT of all rows is met by a broadcast: there are no more than HOT such keys.
LEAST_HOT, HOT = 1000, 10_000
#: Tokens of sets that meet at one task.
TOKENS = 4_000_000


def hot_from(rows: int) -> int:
    return max(LEAST_HOT, rows // HOT)


def _with(rows: DataFrame, keys: DataFrame, key: str, value: str, hot: Column) -> DataFrame:
    """rows with the value of their key: hot keys, of which there are few, come by a broadcast, and no task gets all rows of one."""
    many = F.broadcast(keys.where(hot).select(key, F.col(value).alias("_many")))
    rows = rows.join(many, key, "left").withColumn("_there", F.when(F.col("_many").isNull(), 1))
    # rows that have their value go anywhere
    rows = rows.withColumn("_key", F.when(F.col("_many").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    few = keys.where(~hot).select(F.col(key).alias("_key"), F.lit(1).alias("_there"), F.col(value).alias("_few"))
    return rows.join(few, ["_key", "_there"], "left").withColumn(value, F.coalesce("_many", "_few")).drop("_key", "_there", "_many", "_few")


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def extended(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens the extended prefix has: with x and y tokens that only this or only the other set has,
    100 x + percent y <= (100 - percent) n, so that 2 x + y is no more than 2 (100 - percent) n / 100."""
    return 2 * (100 - percent) * n // 100 + 2


def shingle_sets(batch: pa.RecordBatch, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin (one more at the end)."""
    buf, begin = text_bytes(batch.column(text))
    starts, words = hash_words(buf, lower=True)
    rows = batch.num_rows
    row = np.searchsorted(begin, starts, side="right") - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first)
    at = np.arange(len(words))
    kept_at, kept = [], []
    for length, hashes in run_hashes(words, tuple(range(1, width + 1))).items():
        ok = at[: len(hashes)] + length <= first[row[: len(hashes)] + 1]
        if length < width:
            ok &= n[row[: len(hashes)]] == length
        kept_at.append(np.flatnonzero(ok))
        kept.append(hashes[ok])
    at, tokens = np.concatenate(kept_at), np.concatenate(kept)
    order = np.argsort(at, kind="stable")
    row, tokens = row[at[order]], tokens[order]
    return _sorted_sets(tokens, np.searchsorted(row, np.arange(rows + 1)))


def _sorted_sets(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for a, b in zip(at[:-1], at[1:], strict=True):
        tokens[a:b].sort()
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    new[begins] = True
    return tokens[new], np.concatenate(([0], np.cumsum(new)))[at]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[at[1:]] - total[at[:-1]]


def fingerprints(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at).astype(np.uint64)
    return mix(_sums(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at) + n), mix(_sums(mix(tokens ^ np.uint64(0x14057B7EF767814F)), at) + n)


def _distinct(tokens: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row for each set that is not empty."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    rows = order[new]
    return np.sort(rows[np.diff(at)[rows] > 0])


def _pick(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)[rows]
    begin = np.cumsum(n) - n
    return tokens[np.arange(n.sum()) + np.repeat(at[rows] - begin, n)], np.append(begin, n.sum())


def histograms(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """How many tokens of each set have each value of the low bits: a few to a bin, in a power of two of bins."""
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bins = bins_for(b - a)
        out.append(np.bincount((tokens[a:b] & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype("<u4").astype("<u2" if b - a < 1 << 16 else "<u4").tobytes())
    return out


def bins_for(n: int) -> int:
    return min(4096, max(16, 1 << max(0, (n - 1) // 4).bit_length()))


def can_link(n: np.ndarray, data: list[bytes], percent: int) -> np.ndarray:
    """Whether each set can link with another one of these, by their histograms."""
    out = np.zeros(len(n), dtype=bool)
    order = np.argsort(n, kind="stable")
    k = n[order]
    # partners are no smaller than percent of the larger set, so those of a set lie in a run of the order
    far = np.searchsorted(k, k * 100 // percent, side="right")
    wide = {}

    def folded(i: int, bins: int) -> np.ndarray:
        own = wide.setdefault(i, np.frombuffer(data[i], "<u2" if n[i] < 1 << 16 else "<u4").astype(np.int32))
        return own if len(own) == bins else own.reshape(-1, bins).sum(axis=0)

    for i in range(len(order)):
        wide.pop(order[i - 1], None) if i else None
        bins = bins_for(int(k[i]))
        own = folded(order[i], bins)
        for start in range(i + 1, int(far[i]), 256):
            others = order[start : min(start + 256, int(far[i]))]
            most = np.minimum(np.stack([folded(j, bins) for j in others]), own).sum(axis=1)
            fit = others[100 * most >= percent * (n[others] + k[i] - most)]
            out[fit] = True
            if len(fit):
                out[order[i]] = True
                break
        # a partner later in the order may have gone unmarked; it is looked at from its own side
        if not out[order[i]]:
            near = order[np.searchsorted(k, -(-int(k[i]) * percent // 100)) : i]
            for start in range(0, len(near), 256):
                others = near[start : start + 256]
                small = [bins_for(int(n[j])) for j in others]
                most = np.array([np.minimum(folded(j, b), folded(order[i], b)).sum() for j, b in zip(others, small, strict=True)])
                if (100 * most >= percent * (n[others] + k[i] - most)).any():
                    out[order[i]] = True
                    break
    return out


_SETS = "kind int, key long, a long, b long, n long, part int, data binary"


def _survey(text: str, width: int, slices: int = SLICES):
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, dtype=np.uint32)
        for batch in sized_batches(batches, CHUNK_BYTES):
            tokens, at = shingle_sets(batch, text, width)
            a, b = fingerprints(tokens, at)
            once, _ = _pick(tokens, at, _distinct(tokens, at, a, b))
            classes, n = np.unique((once >> np.uint64(64 - CLASS_BITS)).astype(np.uint32), return_counts=True)
            counts[classes] += n.astype(np.uint32)
            m = batch.num_rows
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(m, np.int32)), "key": batch.column(KEY), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "n": pa.array(np.diff(at).astype(np.int64)), "part": pa.nulls(m, pa.int32()), "data": pa.array(histograms(tokens, at), pa.binary())})
        if counts.any():
            none = pa.nulls(slices, pa.int64())
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(slices, np.int32)), "key": none, "a": none, "b": none, "n": none, "part": pa.array(range(slices), pa.int32()), "data": [squeeze(x, "<i8") for x in np.split(counts, slices)]})

    return survey


def class_levels(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """A level from 0 to 255 for each class, rising with its count, and the first level that is frequent."""
    mean = max(1.0, counts.sum() / len(counts))
    level = lambda c: np.clip(np.rint(24 * np.log2(np.maximum(c, 1) / mean)) + 48, 0, 255)
    return level(counts).astype(np.uint8), int(level(np.float64(FREQUENT * max(mean, FLOOR))))


def prefix_entries(tokens: np.ndarray, at: np.ndarray, levels: np.ndarray, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each index entry: rare tokens, and neighbouring pairs of frequent ones, of the prefixes."""
    level = levels[(tokens >> np.uint64(64 - CLASS_BITS)).astype(np.int64)].astype(np.uint64)
    tokens = (level << np.uint64(56)) | (mix(tokens) >> np.uint64(8))
    for a, b in zip(at[:-1], at[1:], strict=True):
        tokens[a:b].sort()
    n = np.diff(at)
    longest = n - least_overlap(n, percent) + 1
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(tokens)) - np.repeat(at[:-1], n)
    few = np.repeat(n < -(-percent // (100 - percent)), n)  # smaller sets link with none but themselves
    often = (tokens >> np.uint64(56)) >= np.uint64(frequent)
    single = ~often & ~few & (rank < np.repeat(longest, n))
    rows, keys = [row[single]], [mix(tokens[single])]
    started = np.zeros(len(n), dtype=bool)
    started[row[often & ~few & (rank < np.repeat(longest, n))]] = True
    paired = often & np.repeat(started, n) & (rank < np.repeat(extended(n, percent), n))
    i = np.flatnonzero(paired[:-1] & paired[1:] & (row[:-1] == row[1:])) if len(tokens) else np.zeros(0, dtype=np.int64)
    rows.append(row[i])
    keys.append(mix(mix(tokens[i]) * np.uint64(3) + mix(tokens[i + 1])))
    return np.concatenate(rows), np.concatenate(keys)


def _index(text: str, width: int, levels: np.ndarray, frequent: int, percent: int, partitions: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, CHUNK_BYTES):
            tokens, at = shingle_sets(batch, text, width)
            a, b = fingerprints(tokens, at)
            rows = _distinct(tokens, at, a, b)
            tokens, at = _pick(tokens, at, rows)
            entry, key = prefix_entries(tokens, at, levels, frequent, percent)
            node, n = a[rows][entry], np.diff(at)[entry]
            for p, own in parts_by((key % np.uint64(partitions)).astype(np.int32), partitions):
                yield _blob_batch([(p, 0, join_parts([key[own].tobytes(), node[own].tobytes(), squeeze(n[own], "<u4")]))])

    return index


def _distinct_pairs(leader: np.ndarray, member: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((member, leader))
    leader, member, n = leader[order], member[order], n[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (leader[1:] != leader[:-1]) | (member[1:] != member[:-1])
    return leader[new], member[new], n[new]


def _pairs_blob(part: int, leader: np.ndarray, member: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return _blob_batch([(part, 0, join_parts([leader.tobytes(), member.tobytes(), squeeze(n, "<u4")]))])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair once, as a row; the entries that give it are in many partitions."""
    parts = [split_parts(d) for batch in batches for d in batch.column("data").to_pylist()]
    if parts:
        columns = _distinct_pairs(np.concatenate([np.frombuffer(p[0], np.int64) for p in parts]), np.concatenate([np.frombuffer(p[1], np.int64) for p in parts]), np.concatenate([unsqueeze(p[2], "<u4") for p in parts]).astype(np.int64))
        for k in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in columns], names=["leader", "member", "n"])


def _stars(percent: int, partitions: int):
    """Leader and member (with its size) for the entries of each key, band of sizes by band: a band and the next hold all sizes that can link. Blobs go by the pair, so that a large group spreads."""
    width = np.log(100 / percent) * (1 + 1e-9)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [split_parts(d) for batch in batches for d in batch.column("data").to_pylist()]
        if not parts:
            return
        key = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
        node = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
        n = np.concatenate([unsqueeze(p[2], "<u4") for p in parts]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        met = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        key, node, n = key[met], node[met], n[met]
        band = np.floor(np.log(n) / width).astype(np.uint64)
        group = np.concatenate((mix(key + band), mix(key + band - np.uint64(1))))
        node, n = np.concatenate((node, node)), np.concatenate((n, n))
        order = np.lexsort((node, group))
        group, node, n = group[order], node[order], n[order]
        begins = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
        leader = node[np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))] if len(group) else node
        led = leader != node
        for p, own in parts_by(bucket(mix(leader[led]) ^ node[led], partitions), partitions):
            yield _pairs_blob(p, *_distinct_pairs(leader[led][own], node[led][own], n[led][own]))

    return stars


def _possible(percent: int):
    """The members of each job that can link with another one of it."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        key, job, n = (rows.column(c).to_numpy() for c in ("key", "job", "n"))
        data = rows.column("data").to_pylist()
        order = np.argsort(job, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], job[order][1:] != job[order][:-1], [True])))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = order[lo:hi]
            own = own[can_link(n[own], [data[i] for i in own], percent)]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(job[own]), pa.array(n[own])], names=["key", "job", "n"])

    return possible


def _wanted(documents: int):
    """(key, job) pairs, as blobs by the bucket of the key."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, job = batch.column("key").to_numpy(), batch.column("job").to_numpy()
            for p, own in parts_by(bucket(key, documents), documents):
                yield _blob_batch([(p, 0, join_parts([key[own].tobytes(), job[own].tobytes()]))])

    return wanted


def _send(text: str, width: int, jobs: int):
    """The sets of the documents that are wanted, to each task that wants them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, key, job, sent = [], None, None, set()
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind == 0:
                    found.append(tuple(np.frombuffer(x, np.int64) for x in split_parts(data)))
                    continue
                if key is None:
                    key, job = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
                    order = np.argsort(key, kind="stable")
                    key, job = key[order], job[order]
                for rows in bytes_to_rows(data):
                    keys = rows.column(KEY).to_numpy()
                    lo, hi = np.searchsorted(key, keys, side="left"), np.searchsorted(key, keys, side="right")
                    take = [i for i in np.flatnonzero(hi > lo) if keys[i] not in sent and not sent.add(keys[i])]
                    if not take:
                        continue
                    tokens, at = shingle_sets(rows.take(pa.array(take)), text, width)
                    of = np.repeat(np.arange(len(take)), (hi - lo)[take])
                    to = job[np.concatenate([np.arange(lo[i], hi[i]) for i in take])]
                    for p, own in parts_by(bucket(to, jobs), jobs):
                        part, ends = _pick(tokens, at, of[own])
                        yield _blob_batch([(p, 0, join_parts([to[own].tobytes(), keys[take][of[own]].tobytes(), squeeze(np.diff(ends), "<u4"), part.tobytes()]))])

    return send


def link_sets(tokens: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For each set the smallest number of a set that it is connected to, by links among these sets."""
    n = len(at) - 1
    root = np.arange(n)
    size = np.diff(at)
    _, ids = np.unique(tokens, return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    asked = np.zeros(n, dtype=bool)
    while True:
        count = np.bincount(root, minlength=n)
        open_ = np.flatnonzero(~asked & (root != count.argmax()))
        if not len(open_):
            # the rest of the largest component is compared from the other side
            return root
        x = open_[np.argmax(size[open_])] if count.max() == 1 and not asked.any() else open_[0]
        asked[x] = True
        other = np.flatnonzero((root != root[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
        if not len(other):
            continue
        own = ids[at[x] : at[x + 1]]
        mark[own] = True
        part, ends = _pick(ids, at, other)
        both = np.add.reduceat(mark[part].astype(np.int64), ends[:-1])
        mark[own] = False
        for r in {*root[other[100 * both >= percent * (size[other] + size[x] - both)]].tolist()}:
            low, high = sorted((int(r), int(root[x])))
            root[root == high] = low


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [split_parts(d) for batch in batches for d in batch.column("data").to_pylist()]
        if not parts:
            return
        job = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
        key = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
        at = np.concatenate(([0], np.cumsum(np.concatenate([unsqueeze(p[2], "<u4") for p in parts]).astype(np.int64))))
        tokens = np.concatenate([np.frombuffer(p[3], np.uint64) for p in parts])
        del parts
        order = np.lexsort((key, job))
        cut = np.flatnonzero(np.concatenate(([True], job[order][1:] != job[order][:-1], [True])))
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = order[lo:hi]
            root = link_sets(*_pick(tokens, at, own), percent)
            linked = np.flatnonzero(root != np.arange(len(root)))
            a.append(key[own[linked]])
            b.append(key[own[root[linked]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return verify


OUT = ("n_shingles", "component_id", "first_of_component")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT, tokens_each: int = TOKENS) -> DataFrame:
    """All rows of docs with n_shingles (long), component_id (the smallest id reachable by links) and whether the row is the one so named."""
    if not 67 <= percent <= 99:
        raise ValueError("percent from 67 to 99: below, pairs of neighbours may miss links of small sets")
    # all jobs that run Python run here; what is returned only joins their tables
    with small_batches(docs.sparkSession):
        return _components(docs, doc_id, text, width, percent, tokens_each)


def _components(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, tokens_each: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (*OUT, KEY)))
    rows = keyed(docs, doc_id, text)
    own = rows.select(KEY, F.col(f"`{text}`").alias("text"))
    sp = int(spark.conf.get("spark.sql.shuffle.partitions"))

    surveyed = written(own.mapInArrow(_survey("text", width), _SETS), "sets")
    tables = surveyed.where("kind = 0")
    counts = slices_summed(tables.select("part", "kind", "data"), SLICES, 1 << CLASS_BITS, tasks=tables.where("part = 0").count())
    levels, frequent = class_levels(counts)
    sets = surveyed.where("kind = 1").select("key", "a", "b", "n").distinct()
    full = surveyed.where("kind = 1 and n > 0")
    classes = full.groupBy("a", "b").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    shapes = full.groupBy("a", "b").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("data").alias("data"))

    n = max(sp, -(-int(counts.sum()) // (10 * tokens_each)))
    entries = own.mapInArrow(_index("text", width, levels, frequent, percent, n), _BLOB)
    stars = entries.repartitionById(n, "part").mapInArrow(_stars(percent, n), _BLOB)
    pairs = written(stars.repartitionById(n, "part").mapInArrow(_pairs, "leader long, member long, n long"), "pairs")

    def met(jobs: DataFrame, total: int) -> DataFrame:
        """Links (a, b) among the sets of each job (member, job), of total tokens in all."""
        m = max(sp, -(-total // tokens_each))
        shown = jobs.join(shapes.withColumnRenamed("a", "member"), "member").select("key", "job", "n", "data").distinct()
        wanted = written(shown.repartition(m, "job").mapInArrow(_possible(percent), "key long, job long, n long"), "wanted")
        m = max(sp, -(-(wanted.agg(F.sum("n")).first()[0] or 0) // tokens_each))
        both = wanted.mapInArrow(_wanted(n), _BLOB).unionByName(own.mapInArrow(documents_by_key(n), _BLOB)).repartitionById(n, "part").sortWithinPartitions("kind")
        sent = both.mapInArrow(_send("text", width, m), _BLOB)
        return sent.repartitionById(m, "part").mapInArrow(_verify(percent), "a long, b long")

    # a leader's members are one job, or blocks of jobs, if they are many, with the leader in each
    sizes = pairs.groupBy("leader").agg((F.sum("n") + F.max("n")).alias("total"), F.count(F.lit(1)).alias("members"))
    g = F.ceil(F.col("total") * 2 / tokens_each)
    sizes = written(sizes.withColumn("g", F.when(g <= 2, 1).otherwise(g)), "sizes")
    total, n_pairs, n_big = sizes.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("members"), F.lit(0)), F.count_if(F.col("g") > 1)).first()
    members = pairs.select("leader", "member").unionByName(sizes.select("leader", F.col("leader").alias("member")))
    members = _with(members, sizes.select("leader", "members", "g"), "leader", "g", F.col("members") > hot_from(n_pairs))
    big = members.where("g > 1")
    block = F.pmod(F.xxhash64("member"), "g")
    jobs = members.select("member", F.xxhash64("leader", block).alias("job"))
    led = sizes.where("g > 1").select(F.col("leader").alias("member"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("own"))
    links = met(jobs.unionByName(led.select("member", F.xxhash64("leader", "own").alias("job"))), total)
    if n_big:
        # those that the leader's links don't reach meet all others, block by block
        links = written(links, "star-links")
        found = shapes.select(F.col("a").alias("member"), "key", "n").join(components(links), F.col("key") == F.col("node"), "left").select("member", "n", F.coalesce("component", "key").alias("c"))
        found = written(big.select("leader", "member", "g").join(found, "member"), "members")
        reached = found.where("leader = member").select("leader", F.col("c").alias("reached"))
        apart = written(found.join(reached, "leader").where("c <> reached").select("leader", "member", "n", "g"), "apart")
        rest = apart.groupBy("leader").agg(F.ceil(F.sum("n") * 2 / tokens_each).alias("u"), F.sum("n").alias("own"), F.max("g").alias("g"))
        more = rest.agg(F.sum(F.col("own") * F.col("g"))).first()[0]
        if more:
            upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
            both = apart.join(rest.select("leader", "u"), "leader").select("leader", "member", F.pmod(F.xxhash64("member"), "u").alias("x"), upto("g").alias("y"))
            all_ = found.join(rest.select("leader", "u"), "leader").select("leader", "member", upto("u").alias("x"), F.pmod(F.xxhash64("member"), "g").alias("y"))
            links = links.unionByName(met(both.unionByName(all_).select("member", F.xxhash64("leader", "x", "y", F.lit("apart")).alias("job")), int(more)))
    linked = components(links)

    named = classes.join(linked, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("component", "rep").alias("component"))
    # classes of many copies, of which there are few, meet their rows without a shuffle; empty sets have no class to meet
    hot = hot_from(full.count())
    many = F.broadcast(classes.where(F.col("copies") > hot).select("a", "b", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("component", "rep").alias("many")))
    sets = sets.join(many, ["a", "b"], "left")
    alone = F.col("many").isNotNull() | (F.col("n") == 0)
    sets = sets.select("key", "n", "many", F.when(alone, F.col("key")).otherwise(F.col("a")).alias("a"), F.when(~alone, F.col("b")).alias("b"))
    labels = sets.join(named, ["a", "b"], "left").select(F.col("key"), F.col("n").alias("n_shingles"), F.coalesce("many", "component", "key").alias("component_id"))
    labels = labels.withColumn("first_of_component", F.col("component_id") == F.col("key"))
    result = rows.join(labels, F.col(KEY) == F.col("key")).drop("key")
    ids = rows.select(F.col(KEY).alias("_k"), F.col(f"`{doc_id}`").cast("long").alias("_id")).where("_id is null or _id <> _k")
    if not ids.isEmpty():
        ids = rows.select(F.col(KEY).alias("component_id"), F.col(f"`{doc_id}`").alias("_id")).distinct()
        result = result.join(ids, "component_id").drop("component_id").withColumnRenamed("_id", "component_id")
    return result.drop(KEY)

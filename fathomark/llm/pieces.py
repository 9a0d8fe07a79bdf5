"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding starts from single characters and works through an agenda: of all neighbouring pairs
whose text is a piece, the best-scored one is merged, the leftmost if several are alike. A merge
type (left piece, right piece) is skipped where a hash keyed by seed and variant falls below
``dropout``; so a word is cut in the same way all through a variant and differently in others.
A document's variant is a keyed hash of its id modulo ``variants``. With dropout 0 the ids
are those of the sentencepiece library. What no piece covers becomes its bytes.

Pieces join white space on their left alone, so a text falls into units (spaces and what
follows them) that are encoded independently; a worker keeps the ids of units it has seen, up to a
bound. Decoding gives the text back exactly: the character that stands for a space in pieces
is encoded by its bytes where a text has it.

A word has as many segmentations in a corpus as there are variants; each costs a worker its own work and store.

Edge cases: null and empty texts have no ids and decode to the empty text; a null id counts as
variant 0; rows of one id are of one variant, so that repeated rows get the same ids; of pairs with equal scores the leftmost is
merged first; a very long text is encoded whole, its units once for each worker; an empty table gives an empty one; other
columns are kept, except those named like an output column, which are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomark.llm.packing import sized_batches
from fathomark.llm.wordhash import mix

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Units whose ids a worker keeps for all variants; the store is emptied beyond it.
CACHE_UNITS = 400_000
NEVER = 1 << 40
_UNIT = re.compile(" *[^ ]+| +")
OUT = T.StructType([T.StructField("variant", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("roundtrip", T.BooleanType())])


class Pieces:
    """The pieces of a byte-fallback BPE model and its merge types."""

    def __init__(self, path: str) -> None:
        """path: a model file."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.name != "identity":
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        normal = sorted((-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL)
        #: Symbols are numbered by rank: the lower, the earlier it is merged.
        self.id_of = [i for _, i in normal]
        text = [model.pieces[i].piece for i in self.id_of]
        self.rank = {p: r for r, p in enumerate(text)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.width = len(text).bit_length()
        single = {p for p in text if len(p) == 1}
        merges = {}
        for r, p in enumerate(text):
            for k in range(1, len(p)):
                a, b = self.rank.get(p[:k]), self.rank.get(p[k:])
                if a is not None and b is not None:
                    merges[a << self.width | b] = r
        self.merges, self.single = merges, single
        self.arrays()
        self.shown = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            self.shown[i] = p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b""

    def arrays(self) -> None:
        """Sorted merge keys, what they make, and the symbol of each code point: a space is SPACE, and SPACE itself no piece."""
        self.keys = np.sort(np.fromiter(self.merges, dtype=np.int64, count=len(self.merges)))
        self.made = np.array([self.merges[k] for k in self.keys.tolist()] or [0], dtype=np.int64)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for p in self.single - {SPACE}:
            self.symbol[ord(p)] = self.rank[p]
        self.symbol[ord(" ")] = self.rank[SPACE]
        self.ids = np.array(self.id_of, dtype=np.int64)
        self.bytes = np.array([self.byte_id[b] for b in range(256)], dtype=np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray, variant: np.ndarray, key: int, least: int) -> np.ndarray:
        """What neighbours a and b merge into, or NEVER; a merge type is skipped where its keyed hash is below least."""
        pair = a << self.width | b
        at = np.minimum(np.searchsorted(self.keys, pair), max(0, len(self.keys) - 1))
        out = np.where((a >= 0) & (b >= 0) & (self.keys[at] == pair), self.made[at], NEVER)
        if least:
            salt = mix(np.uint64(key) + variant.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[mix(pair.view(np.uint64) ^ salt) < np.uint64(least)] = NEVER
        return out

    def merge(self, symbols: np.ndarray, length: np.ndarray, variant: np.ndarray, key: int, least: int) -> np.ndarray:
        """Work through the agendas of all rows of symbols (padded) at once; symbols that are gone become NEVER."""
        rows, width = symbols.shape
        place = np.arange(width)
        symbols = np.where(place < length[:, None], symbols, NEVER)
        follows = np.broadcast_to(place + 1, (rows, width)).copy()
        before = follows - 2
        agenda = np.full((rows, width), NEVER, dtype=np.int64)
        r, c = np.nonzero(place < length[:, None] - 1)
        agenda[r, c] = self.pair(symbols[r, c], symbols[r, c + 1], variant[r], key, least)
        open_ = np.arange(rows)
        while len(open_):
            at = agenda[open_].argmin(axis=1)
            best = agenda[open_, at]
            going = best != NEVER
            open_, at, best = open_[going], at[going], best[going]
            right = follows[open_, at]
            symbols[open_, at] = best
            symbols[open_, right] = NEVER
            agenda[open_, right] = NEVER
            after = follows[open_, right]
            follows[open_, at] = after
            agenda[open_, at] = NEVER
            has = after < length[open_]
            r, c, n = open_[has], at[has], after[has]
            before[r, n] = c
            agenda[r, c] = self.pair(best[has], symbols[r, n], variant[r], key, least)
            has = before[open_, at] >= 0
            r, c, n = open_[has], at[has], before[open_, at][has]
            agenda[r, n] = self.pair(symbols[r, n], best[has], variant[r], key, least)
        return symbols

    def segment(self, units: list[str], variant: np.ndarray, key: int, least: int) -> list[bytes]:
        """Ids of each unit, as 32-bit integers in bytes."""
        length = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        symbols = self.symbol[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        begin = np.cumsum(length) - length
        out: list[bytes] = [b""] * len(units)
        order = np.argsort(length, kind="stable")
        k = 0
        while k < len(order):
            # rows of similar length, about a million symbols at a time
            most = max(16, int(length[order[k]] * 3 // 2))
            end = min(int(np.searchsorted(length[order], most, side="right")), k + max(1, (1 << 20) // most))
            own = order[k:end]
            k = end
            width = int(length[own].max())
            at = np.minimum(begin[own][:, None] + np.arange(width), len(symbols) - 1)
            left = self.merge(symbols[at], length[own], variant[own], key, least)
            flat, n = left[left != NEVER], (left != NEVER).sum(axis=1)
            ids, size = self._ids(flat)
            ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))] * 4
            data = ids.astype("<i4").tobytes()
            for i, a, b in zip(own.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i] = data[a:b]
        return out

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many of each; characters that are no piece give their UTF-8 bytes."""
        point = np.maximum(-1 - symbols, 0)
        size = np.where(symbols >= 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        begin = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), dtype=np.int64)
        known = symbols >= 0
        ids[begin[known]] = self.ids[symbols[known]]
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own = np.flatnonzero(~known & (size == n))
            for k in range(n) if len(own) else ():
                part = point[own] >> (6 * (n - 1 - k))
                ids[begin[own] + k] = self.bytes[part | lead if k == 0 else part & 0x3F | 0x80]
        return ids, size


class Codec:
    def __init__(self, path: str, *, seed: int = 0, dropout: float = 0.1, variants: int = 8) -> None:
        self.pieces, self.seed, self.variants = Pieces(path), seed, variants
        self.least = 0 if dropout <= 0 else int(min(dropout, 1.0) * (2**64 - 2**11))
        self.key = int(mix(np.array([seed + 1], dtype=np.int64).view(np.uint64))[0])
        self.known: list[dict[str, bytes]] = [{} for _ in range(variants)]

    def variants_of(self, doc_ids: list[int | None]) -> list[int]:
        keys = np.array([int(d or 0) for d in doc_ids], dtype=np.int64).view(np.uint64)
        drawn = (mix(keys ^ np.uint64(self.key)) % np.uint64(self.variants)).tolist()
        return [0 if d is None else v for d, v in zip(doc_ids, drawn, strict=True)]

    def encode(self, texts: list[str | None], variants: list[int]) -> list[np.ndarray]:
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        if sum(map(len, self.known)) > CACHE_UNITS:
            for k in self.known:
                k.clear()
        new, of = [], []
        for v in range(self.variants):
            own = set().union(*(us for us, w in zip(units, variants, strict=True) if w == v)) - self.known[v].keys()
            new += own
            of += [v] * len(own)
        if new:
            for u, v, ids in zip(new, of, self.pieces.segment(new, np.array(of), self.key, self.least), strict=True):
                self.known[v][u] = ids
        return [np.frombuffer(b"".join(map(self.known[v].__getitem__, us)), dtype="<i4") for us, v in zip(units, variants, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.pieces.shown.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "surrogatepass")


_codecs: dict[tuple, Codec] = {}


def encode_pieces(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text", seed: int = 0, dropout: float = 0.1, variants: int = 8, keep_ids: bool = True) -> DataFrame:
    """All rows of docs with the columns of OUT: the ids, and whether they decode to the text. keep_ids: with the ids themselves."""
    out = [f for f in OUT if keep_ids or f.name != "ids"]
    kept = [f for f in docs.schema if f.name not in OUT.names]
    schema = T.StructType([*kept, *out])
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, seed, dropout, variants)
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(model, seed=seed, dropout=dropout, variants=variants)
        codec = _codecs[key]
        for batch in sized_batches(batches, 4 << 20):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made: dict[str, list] = {f.name: [] for f in out}
                texts = part.column(text).to_pylist()
                variants_ = codec.variants_of(part.column(doc_id).to_pylist())
                for t, variant, ids in zip(texts, variants_, codec.encode(texts, variants_), strict=True):
                    row = (variant, ids, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), codec.decode(ids) == (t or ""))
                    for name, v in zip(OUT.names, row, strict=True):
                        if name in made:
                            made[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else part.column(f.name) for f in arrow], schema=arrow)

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(encode, schema)

"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction keeps a state h. A byte x and the state give t = tanh(W[x] + h U), whose halves are
a gate f = (1 + t0) / 2 and a candidate c = t1; the state becomes h + f (c - h). Both states at a
position give the probabilities of the languages there, so every byte is labelled; a document's
probabilities are the means over its bytes. Every byte of a text is read; states run through ``SEGMENT`` bytes, in
both directions, and start anew in the next ones, so that segments of all texts go through the network side by side.

The network is trained here, in numpy, by backpropagation through time and Adam, on a bounded
sample: at most ``rows_per_lang`` labelled ids of each language, those with the smallest hash of
their id, and from each a piece of ``piece`` characters at a place that the hash chooses. The sample
does not grow with the table: the ids of each language are counted, and a bound for the hash, a little above what gives
enough ids, leaves some thousand rows of a language before any are sorted. More than ``MAX_LANGS`` languages are refused.

Edge cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; rows with a null id or null
language are never learned from; an id given more than once is learned from once (its smallest piece); without any
labelled row every text is ``und``; where languages are equally probable the first by name is taken; repeated rows are
judged each by itself; a very long text is one row in memory, its segments a few thousand at a time; an empty table gives
an empty one; other columns are kept, except those named like an output column, which are replaced.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomark.llm.packing import sized_batches
from fathomark.llm.wordhash import text_bytes

HIDDEN = 12
SEGMENT = 512
MAX_LANGS = 1000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("label_share", T.DoubleType())])


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {"V": draw(2 * hidden, len(langs), scale=0.3), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            w["W" + d] = draw(256, 2 * hidden, scale=0.5)
            w["U" + d] = draw(hidden, 2 * hidden, scale=0.5 / np.sqrt(hidden))
        return cls(langs, w)

    def states(self, x: np.ndarray, direction: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Place, t, state before and after it, for bytes x (places, rows)."""
        W, U = self.weights["W" + direction], self.weights["U" + direction]
        hidden = U.shape[0]
        h = np.zeros((x.shape[1], hidden), np.float32)
        for k in range(len(x)) if direction == "f" else range(len(x) - 1, -1, -1):
            t = h @ U
            t += W[x[k]]
            np.tanh(t, out=t)
            new = t[:, hidden:] - h
            new *= t[:, :hidden] * np.float32(0.5) + np.float32(0.5)
            new += h
            yield k, t, h, new
            h = new

    def probabilities(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Place and the languages' probabilities there (rows, languages)."""
        hidden = self.weights["Uf"].shape[0]
        V, c = self.weights["V"], self.weights["c"]
        forward = np.empty((*x.shape, len(c)), np.float32)
        for k, _, _, h in self.states(x, "f"):
            np.matmul(h, V[:hidden], out=forward[k])
        for k, _, _, h in self.states(x, "b"):
            z = h @ V[hidden:]
            z += forward[k]
            z += c
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            yield k, z

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients over all positions; y is the row's language, weight the language's."""
        w, (places, rows), hidden = self.weights, x.shape, self.weights["Uf"].shape[0]
        seen = {d: list(self.states(x, d)) for d in "fb"}
        after = {d: np.empty((places, rows, hidden), np.float32) for d in "fb"}
        for d in "fb":
            for k, _, _, h in seen[d]:
                after[d][k] = h
        both = np.concatenate((after["f"], after["b"]), axis=2).reshape(-1, 2 * hidden)
        z = both @ w["V"] + w["c"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        each = (mask * weight[y]).reshape(-1).astype(np.float32)
        each /= max(1e-6, each.sum())
        target = np.tile(y, places)
        loss = -float((each * np.log(p[np.arange(len(p)), target] + 1e-9)).sum())
        dz = p
        dz[np.arange(len(p)), target] -= 1
        dz *= each[:, None]
        grads = {"V": both.T @ dz, "c": dz.sum(axis=0)}
        dboth = (dz @ w["V"].T).reshape(places, rows, 2 * hidden)
        flat = x.reshape(-1)
        for i, d in enumerate("fb"):
            U = w["U" + d]
            da = np.empty((places, rows, 2 * hidden), np.float32)
            before = np.empty((places, rows, hidden), np.float32)
            dh = np.zeros((rows, hidden), np.float32)
            for k, t, h, _ in reversed(seen[d]):
                dh = dh + dboth[k, :, i * hidden : (i + 1) * hidden]
                gate = t[:, :hidden] * np.float32(0.5) + np.float32(0.5)
                dt = np.concatenate((np.float32(0.5) * dh * (t[:, hidden:] - h), dh * gate), axis=1)
                dt *= 1 - t * t
                da[k], before[k] = dt, h
                dh = dh * (1 - gate) + dt @ U.T
            da = da.reshape(-1, 2 * hidden)
            grads["U" + d] = before.reshape(-1, hidden).T @ da
            grads["W" + d] = np.stack([np.bincount(flat, weights=da[:, j], minlength=256) for j in range(2 * hidden)], axis=1).astype(np.float32)
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, *, steps: int, rows: int, rate: float, rng: np.random.Generator) -> list[float]:
        """Adam over random rows; x and mask are (rows, places)."""
        count = np.bincount(y, minlength=len(self.langs))
        weight = (len(y) / np.maximum(1, count * len(self.langs))).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            own = rng.integers(0, len(y), rows)
            loss, grads = self.gradients(np.ascontiguousarray(x[own].T), y[own], np.ascontiguousarray(mask[own].T), weight)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                now = rate * (1 - 0.9 * step / steps)
                self.weights[k] = (self.weights[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def segments(lengths: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of each segment of size bytes."""
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), n)
    start = begin[text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    return text, start, np.minimum(start + size, (begin + lengths)[text])


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, rows_per_lang: int, piece: int) -> DataFrame:
    """The bounded sample: lang and piece, by language those with the smallest hash of the id."""
    t, key = F.col(f"`{text}`"), F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit(17))
    at = F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit(29)), F.greatest(F.length(t) - piece, F.lit(1)).cast("long")) + 1
    rows = docs.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{lang}`").isNotNull() & t.isNotNull())
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), key.alias("key"), F.substr(t, at.cast("int"), F.lit(piece)).alias("piece"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    # wide enough that a tenth of error in a count, and chance, leave rows_per_lang ids
    wanted = 1.25 * rows_per_lang + 10 * math.sqrt(rows_per_lang)
    below = {r.lang: (1 << 63) - 1 if r.n <= wanted else int(wanted / r.n * 2**64) - (1 << 63) for r in counts}
    bound = F.from_json(F.lit(json.dumps(below)), "map<string,long>")
    few = rows.where(F.col("key") <= bound[F.col("lang").cast("string")]).groupBy("lang", "key").agg(F.min("piece").alias("piece"))
    return few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("_n") <= rows_per_lang).select("lang", "key", "piece")


def fit_rows(rows: list[tuple[str, str]], *, hidden: int = HIDDEN, steps: int = 260, batch: int = 512, places: int = 64, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network for rows of language and text."""
    rows = [r for r in rows if _LETTER.search(r[1])]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    buf, begin = text_bytes(pa.array([r[1] for r in rows]))
    lengths = np.diff(np.append(begin, len(buf))) - 1
    of, start, end = segments(lengths, begin, places)
    at = start[:, None] + np.arange(places)
    mask = at < end[:, None]
    x = np.where(mask, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.int64)
    y = np.array([langs.index(r[0]) for r in rows])[of]
    rng = np.random.default_rng(seed)
    network = Network.fresh(langs, hidden, rng)
    network.fit(x, y, mask.astype(np.float32), steps=steps, rows=min(batch, 4 * len(y)), rate=rate, rng=rng)
    return network


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 800, piece: int = 400, **how) -> Network | None:
    """Learn from the bounded sample, in one task of the cluster."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "piece")), strict=True))
        network = fit_rows([(r[0], r[2]) for r in rows], **how)
        if network:
            yield pa.RecordBatch.from_pydict({"network": [pickle.dumps(network)]})

    made = training_rows(docs, doc_id, text, lang, rows_per_lang, piece).repartition(1).mapInArrow(fit, "network binary").collect()
    return pickle.loads(made[0].network) if made else None


def label(network: Network, column: pa.Array, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mean probabilities of its bytes, and how many bytes have each label."""
    buf, begin = text_bytes(column)
    lengths = np.diff(np.append(begin, len(buf))) - 1
    of, start, end = segments(lengths, begin, SEGMENT)
    total = np.zeros((len(lengths), len(network.langs)))
    votes = np.zeros((len(lengths), len(network.langs)))
    place = np.arange(SEGMENT)[:, None]
    rows = max(64, min(rows, (1 << 23) // (SEGMENT * len(network.langs))))
    for k in range(0, len(of), rows):
        own, at = of[k : k + rows], start[None, k : k + rows] + place
        mask = at < end[None, k : k + rows]
        x = np.where(mask, buf[np.minimum(at, len(buf) - 1)], 0)
        p_sum = np.zeros((len(own), len(network.langs)), np.float32)
        v_sum = np.zeros((len(own), len(network.langs)), np.float32)
        for j, p in network.probabilities(x):
            p *= mask[j][:, None]
            p_sum += p
            v_sum += (p == p.max(axis=1, keepdims=True)) & mask[j][:, None]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        total[own[first]] += np.add.reduceat(p_sum, first, axis=0)
        votes[own[first]] += np.add.reduceat(v_sum, first, axis=0)
    n = np.maximum(1, lengths)[:, None]
    return total / n, votes / n


def identify(docs: DataFrame, network: Network | None, *, text: str = "text") -> DataFrame:
    """All rows of docs with lang_pred, score (its pooled probability) and label_share (the share of bytes labelled so)."""
    kept = [f for f in docs.schema if f.name not in OUT.names]
    schema = T.StructType([*kept, *OUT])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, 4 << 20):
            texts = batch.column(text)
            has = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
            made: dict[str, list] = {f.name: [] for f in OUT}
            p, share = label(network, texts) if network else (np.zeros((len(has), 1)), np.zeros((len(has), 1)))
            best = p.argmax(axis=1)
            for i, ok in enumerate(has):
                k = best[i]
                row = (network.langs[k], min(1.0, float(p[i, k])), float(share[i, k])) if ok and network else (UNKNOWN, 0.0, 0.0)
                for name, v in zip(OUT.names, row, strict=True):
                    made[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else batch.column(f.name) for f in arrow], schema=arrow)

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)

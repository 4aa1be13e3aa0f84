"""Quality of texts by a byte-level convolutional network, trained on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import texts
from cohortloom.session import materialised

#: Most labelled rows of each class that the network is trained on, and most bytes of their whole texts together.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 8 << 20
CELL = 64  # bytes in a cell; filters are max-pooled within it
CHUNK = 8  # cells in a chunk
STEP = 7  # cells from one chunk to the next, so that chunks overlap by a cell
WIDTH = 8  # bytes that a filter sees
STRIDE = 2
CHANNELS = 6
FILTERS = 24
SLICE = 1024  # chunks whose responses are in memory at a time


@dataclass
class Network:
    """Byte embedding, filters over ``WIDTH`` embedded bytes, and weights of each filter's mean and greatest chunk."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    shift: np.ndarray

    @classmethod
    def start(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(0.5, 256, CHANNELS), draw(0.3, WIDTH * CHANNELS, FILTERS), np.zeros(FILTERS, np.float32),
                   draw(0.2, 2 * FILTERS), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.top, self.shift]


def _layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by ``WIDTH`` or more zero bytes up to whole cells, and their first cells."""
    cells = -(-(np.diff(offsets) + WIDTH) // CELL)
    first = np.concatenate([[0], np.cumsum(cells)])
    out = np.zeros(first[-1] * CELL + WIDTH, np.uint8)
    for at, i, j in zip(first[:-1] * CELL, offsets[:-1], offsets[1:], strict=True):
        out[at : at + j - i] = data[i:j]
    return out, first


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First cell and end of every chunk, and the number of chunks of each text; chunks cover all cells."""
    cells = np.diff(first)
    count = np.maximum(1, -(-(cells - (CHUNK - STEP)) // STEP))
    text = np.repeat(np.arange(len(cells)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + nth * STEP
    return begin, np.minimum(begin + CHUNK, first[text + 1]), count


def _responses(net: Network, padded: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedded bytes that each filter position sees, and what the filters give there; a position that reaches
    from the zero bytes after a text into the next text gives nothing."""
    flat = net.embedding[padded].reshape(-1)
    n = (len(padded) - WIDTH) // STRIDE
    seen = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * CHANNELS), (4 * CHANNELS * STRIDE, 4))
    out = seen @ net.filters
    for k in range(1, WIDTH // STRIDE):
        out[first[1:] * (CELL // STRIDE) - k] = -np.inf
    return seen, out


def _sliced(net: Network, padded: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``SLICE`` chunks: their numbers (from, to), the first cell, and ``_responses`` from that cell on."""
    for a in range(0, len(begin), SLICE):
        b = min(a + SLICE, len(begin))
        lo, hi = begin[a], end[b - 1]
        inside = first[np.searchsorted(first, lo, "right") : np.searchsorted(first, hi, "right")] - lo
        yield a, b, lo, *_responses(net, padded[lo * CELL : hi * CELL + WIDTH], np.concatenate([[0], inside]))


def _pooled(responses: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    cells = responses.reshape(-1, CELL // STRIDE, FILTERS).max(axis=1)
    cells = np.concatenate([cells, np.full((1, FILTERS), -np.inf, np.float32)])
    return np.maximum.reduceat(cells, np.stack([begin, end], 1).reshape(-1), axis=0)[::2]


def _combined(active: np.ndarray, count: np.ndarray) -> np.ndarray:
    start = np.cumsum(count) - count
    mean = np.add.reduceat(active, start, axis=0) / count[:, None].astype(np.float32)
    return np.concatenate([mean, np.maximum.reduceat(active, start, axis=0)], axis=1)


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text, from all its bytes; an empty text is one cell of zeros.

    Beside the texts and a padded copy of them, memory holds 24 numbers a chunk and the responses of ``SLICE`` chunks.
    """
    padded, first = _layout(data, offsets)
    begin, end, count = _chunks(first)
    best = [_pooled(responses, begin[a:b] - lo, end[a:b] - lo) for a, b, lo, _, responses in _sliced(net, padded, first, begin, end)]
    active = np.maximum(np.concatenate(best) + net.bias, 0)
    z = (_combined(active, count) @ net.top + net.shift[0]).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(net: Network, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    padded, first = _layout(data, offsets)
    begin, end, count = _chunks(first)
    slices = _sliced(net, padded, first, begin, end)
    held = list(slices) if len(begin) <= SLICE else None  # a longer batch goes through its slices twice
    best = [_pooled(responses, begin[a:b] - lo, end[a:b] - lo) for a, b, lo, _, responses in held or slices]
    active = np.maximum(np.concatenate(best) + net.bias, 0)
    rep = _combined(active, count)
    p = 1 / (1 + np.exp(-np.clip(rep @ net.top + net.shift[0], -30, 30)))
    dz = ((p - label) * weight / len(weight)).astype(np.float32)
    text = np.repeat(np.arange(len(count)), count)
    d_rep = dz[:, None] * net.top
    is_top = active == rep[text, FILTERS:]
    ties = np.add.reduceat(is_top.astype(np.float32), np.cumsum(count) - count, axis=0)
    d_active = d_rep[text, :FILTERS] / count[text, None] + is_top * d_rep[text, FILTERS:] / ties[text]
    d_active = np.where(active > 0, d_active, 0).astype(np.float32)
    d_filters, d_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    per_cell = CELL // STRIDE
    for a, b, lo, seen, responses in held or _sliced(net, padded, first, begin, end):
        for c in a + np.flatnonzero(np.any(d_active[a:b] != 0, axis=1)):
            low = (begin[c] - lo) * per_cell
            at = low + responses[low : (end[c] - lo) * per_cell].argmax(axis=0)
            d_filters += seen[at].T * d_active[c]
            d_seen = (net.filters * d_active[c]).T.reshape(FILTERS, WIDTH, CHANNELS)
            np.add.at(d_embedding, padded[lo * CELL + at[:, None] * STRIDE + np.arange(WIDTH)], d_seen)
    return [d_embedding, d_filters, d_active.sum(axis=0), dz @ rep, dz.sum(keepdims=True)]


def fit(samples: list[tuple[bytes, int]], share: float = 0.5, passes: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Train by Adam, label 1 weighing ``share`` in all. With no sample of a class the network says 0.5 or that class."""
    net = Network.start(seed)
    labels = np.array([y for _, y in samples], np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.top[:] = 0
        net.shift[0] = 0 if not len(labels) else (4 if labels[0] else -4)
        return net
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in net.parts()]
    step, total = 0, passes * -(-len(labels) // batch)
    for _ in range(passes):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            blobs = [samples[i][0] for i in own]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
            grads = _gradients(net, np.frombuffer(b"".join(blobs), np.uint8), offsets, labels[own], weight[own])
            step += 1
            now = rate * (1 - step / (total + 1))
            for x, g, (m, v) in zip(net.parts(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Network:
    """Train on whole texts of at most ``rows`` labelled documents and ``size`` bytes of each class.

    ``labels`` has doc_id and label (0, 1; anything else is left out). An id with several labels has the greatest, an
    id with several texts the first in binary order. Documents come in the order of the hashes of their ids; one whose
    text does not fit into what is left of ``size`` is left out of the sample, never cut, so that at most 2 * ``size`` bytes reach
    the driver. The classes weigh as often as they occur.
    """
    labels = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    if not counts:
        return fit([])
    order, spark = F.xxhash64("doc_id"), docs.sparkSession
    chosen = labels.where("label = 0").orderBy(order, "doc_id").limit(rows).union(
        labels.where("label = 1").orderBy(order, "doc_id").limit(rows))
    chosen = spark.createDataFrame(chosen.collect(), "doc_id bigint, label int")
    own = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * rows at most
    own = own.groupBy("doc_id", "label").agg(F.min("text").cast("binary").alias("bytes"))
    own = materialised(own.withColumn("size", F.octet_length("bytes")), "quality-sample")
    left, taken = {0: size, 1: size}, []
    for r in own.select("doc_id", "label", "size").orderBy(order, "doc_id").collect():  # 2 * rows at most
        if r["size"] <= left[r.label]:
            left[r.label] -= r["size"]
            taken.append((r.doc_id,))
    own = own.join(F.broadcast(spark.createDataFrame(taken, "doc_id bigint")), "doc_id")
    samples = sorted((bytes(r.bytes), r.label) for r in own.select("bytes", "label").collect())
    return fit(samples, counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, net: Network, keep: list[Column | str] | None = None, target: str = "score") -> DataFrame:
    """The columns ``keep`` of every row (all, if None) and ``target``, the probability of label 1 from the whole text.

    A null text scores as the empty one. A column named as the target is replaced. Repeated rows score alike.
    """
    base = docs.select(*keep) if keep is not None else docs
    names = [c for c in base.columns if c != target]
    source = docs.select(*[c for c in (keep if keep is not None else docs.columns) if c != target], F.col("text").alias(target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts.flat(batch.column(target))
            parts = [
                probabilities(net, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for i, j in texts.slices(offsets, 1 << 18)
            ]
            out = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(out)], names=[*names, target])

    schema = T.StructType([source.schema[c] for c in names] + [T.StructField(target, T.DoubleType())])
    return source.mapInArrow(run, schema)

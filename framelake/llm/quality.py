"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.sample import labelled_sample
from framelake.llm.text import Texts, slices, texts

#: Bytes of a chunk, and between the beginnings of two; the rest of a chunk overlaps the next one.
CHUNK, STEP = 512, 384
WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 8, 24
#: Training rows of each class, and training chunks of each text, at most (fitting only; scoring takes all).
PER_CLASS, CHUNKS_A_TEXT, EPOCHS = 1500, 6, 6


class Network(NamedTuple):
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def chunk_counts(sizes: np.ndarray) -> np.ndarray:
    """Chunks that cover a text of each size; an empty text has one, of padding."""
    return 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP))


def chunks_of(source: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All chunks as rows of bytes, padded with zeros, and the text of each."""
    sizes = np.diff(source.starts)
    counts = chunk_counts(sizes)
    row = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin, end = source.starts[row] + number * STEP, source.starts[row + 1]
    padded = np.concatenate([source.data, np.zeros(CHUNK + 1, np.uint8)])
    at = begin[:, None] + np.arange(CHUNK)
    out = padded[np.minimum(at, len(padded) - 1)]
    out[at >= end[:, None]] = 0
    return out, row


def _windows(chunks: np.ndarray, embed: np.ndarray) -> np.ndarray:
    taken = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STRIDE]
    return embed[taken].reshape(len(chunks), taken.shape[1], WIDTH * EMBED)


def pooled(chunks: np.ndarray, embed: np.ndarray, filters: np.ndarray, bias: np.ndarray, block: int = 128) -> np.ndarray:
    """The largest answer of each filter in each chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for a in range(0, len(chunks), block):
        x = _windows(chunks[a : a + block], embed)
        out[a : a + block] = (x.reshape(-1, x.shape[2]) @ filters).reshape(len(x), -1, FILTERS).max(axis=1)
    return np.maximum(out + bias, 0)


def combined(features: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest of each text's chunk features (row: sorted, without gaps)."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(np.append(first, len(row)))[:, None]
    return np.hstack(
        [
            np.add.reduceat(features, first, axis=0) / count,
            np.maximum.reduceat(features, first, axis=0),
            np.minimum.reduceat(features, first, axis=0),
        ]
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, which is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (y - p) - shrink * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(chunks: np.ndarray, row: np.ndarray, y: np.ndarray, seed: int = 5) -> Network | None:
    """Filters by Adam on the labels of chunks, then one logistic layer on the combined features of texts."""
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
    filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32)
    bias = np.zeros(FILTERS, np.float32)
    out, out_bias = rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32)
    params = [embed, filters, bias, out, out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = y[row].astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(chunks))
        for a in range(0, len(order), 128):
            pick = order[a : a + 128]
            data = chunks[pick]
            x = _windows(data, embed)
            answer = (x.reshape(-1, x.shape[2]) @ filters).reshape(len(x), -1, FILTERS)
            best = answer.argmax(axis=1)
            top = np.take_along_axis(answer, best[:, None, :], 1)[:, 0] + bias
            active = np.maximum(top, 0)
            error = (sigmoid(active @ out + out_bias) - target[pick]) / len(pick)
            g_top = error[:, None] * out * (top > 0)
            x_best = x[np.arange(len(x))[:, None], best]
            g_filters = np.einsum("nf,nfk->kf", g_top, x_best)
            at = best[:, :, None] * STRIDE + np.arange(WIDTH)
            touched = data[np.arange(len(data))[:, None, None], at]
            g_x = (g_top[:, :, None] * filters.T[None]).reshape(len(data), FILTERS, WIDTH, EMBED)
            g_embed = np.zeros_like(embed)
            np.add.at(g_embed, touched.reshape(-1), g_x.reshape(-1, EMBED))
            step += 1
            grads = [g_embed, g_filters, g_top.sum(0), active.T @ error + 1e-4 * out, error.sum(keepdims=True)]
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    features = combined(pooled(chunks, embed, filters, bias), row)
    mean, scale = features.mean(0), features.std(0) + 1e-6
    return Network(embed, filters, bias, mean, scale, logistic((features - mean) / scale, y.astype(float)))


def probabilities(network: Network | None, source: Texts) -> np.ndarray:
    n = len(source.starts) - 1
    if network is None or not n:
        return np.full(n, 0.5)
    out = np.empty(n)
    # A block holds whole texts of about 1,000 chunks together; one longer text is taken in stretches.
    counts = chunk_counts(np.diff(source.starts))
    block = np.cumsum(counts) // 1000
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        part = Texts(source.data[source.starts[a] : source.starts[b]], source.starts[a : b + 1] - source.starts[a])
        chunks, row = chunks_of(part)
        features = combined(pooled(chunks, network.embed, network.filters, network.bias), row)
        out[a:b] = sigmoid(((features - network.mean) / network.scale) @ network.weights[:-1] + network.weights[-1])
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, per_class: int = PER_CLASS) -> Network | None:
    """The network of at most `per_class` labelled rows of each class, of which it sees CHUNKS_A_TEXT chunks
    spread over the text; so the driver gets some MB at most. None if a class has no row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            chunks, row = chunks_of(texts(part.column("text")))
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            keep = np.concatenate(
                [np.unique(np.linspace(a, b - 1, min(b - a, CHUNKS_A_TEXT)).astype(int)) for a, b in zip(first, first[1:])]
            )
            y = part.column("y").to_numpy(zero_copy_only=False)
            ids = part.column("doc_id").cast(pa.string()).to_pylist()
            yield pa.record_batch(
                [
                    pa.array([ids[r] for r in row[keep]], pa.string()),
                    pa.array(keep, pa.int64()),
                    pa.array(y[row[keep]], pa.int32()),
                    pa.array([c.tobytes() for c in chunks[keep]], pa.binary()),
                ],
                names=["id", "chunk", "y", "body"],
            )

    sample = labelled_sample(docs, labels, label, learn, per_class)
    got = sample.mapInArrow(cut, "id string, chunk long, y int, body binary").toArrow()
    order = got.sort_by([("id", "ascending"), ("chunk", "ascending")])
    if not order.num_rows:
        return None
    ids = np.array(order.column("id").to_pylist())
    row = np.cumsum(np.append(False, ids[1:] != ids[:-1]))
    y = order.column("y").to_numpy()
    chunks = np.frombuffer(b"".join(order.column("body").to_pylist()), np.uint8).reshape(-1, CHUNK)
    return train(chunks, row, y[np.flatnonzero(np.diff(row, prepend=-1))])


def score(docs: DataFrame, network: Network | None, name: str = "score") -> DataFrame:
    """`docs` with the probability of the good class in column `name` (replaced if there).

    Every byte of a text lies in a chunk; a null or empty text is one chunk of padding. Without a network
    (no labels, or of one class) all scores are 0.5. Other columns, nulls and repeated rows pass unchanged.
    """
    kept = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some 30 kB at any size of the tables
    schema = type(kept.schema)([*kept.schema.fields]).add(name, "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = pa.array(probabilities(shared.value, texts(part.column("text"))), pa.float64())
            yield pa.record_batch([*part.columns, found], names=[*part.schema.names, name])

    return kept.mapInArrow(apply, schema)


def judged(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

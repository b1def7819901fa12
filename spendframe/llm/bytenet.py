"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. In each chunk, filters of eight
embedded bytes are applied at every fourth position and max-pooled; the mean and the maximum of the
pooled values over the chunks go into one logistic unit. Embeddings, filters and unit are learned
together on the driver from a bounded sample of labelled texts; scoring runs in Arrow batches.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spendframe.llm.common import buffer, slices

CHUNK, STEP = 512, 480
WIDTH, STRIDE, DEPTH, FILTERS = 8, 4, 8, 24
CHUNKS_AT_ONCE = 256
EPOCHS, BATCH, RATE = 8, 32, 0.01


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray  # FILTERS
    unit: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.unit, self.offset]


def chunk_counts(lengths: np.ndarray) -> np.ndarray:
    """Chunks of each text; an empty text has one, of zero bytes."""
    return 1 + np.maximum(0, -(-(lengths - CHUNK) // STEP))


def chunks_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes from each start, zero from its text's end on."""
    at = starts[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def convolve(network: Network, chunks: np.ndarray) -> np.ndarray:
    """Filter outputs (chunk, position, filter) at every fourth byte, before the bias."""
    embedded = network.embedding[chunks]
    even = embedded.reshape(-1, WIDTH * DEPTH) @ network.filters
    odd = np.ascontiguousarray(embedded[:, STRIDE:-STRIDE]).reshape(-1, WIDTH * DEPTH) @ network.filters
    return np.concatenate((even.reshape(len(chunks), -1, FILTERS), odd.reshape(len(chunks), -1, FILTERS)), axis=1)


def pooled(network: Network, chunks: np.ndarray) -> np.ndarray:
    return np.maximum(convolve(network, chunks).max(axis=1) + network.bias, 0)


def score(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text of a buffer."""
    counts = chunk_counts(np.diff(offsets))
    first = np.concatenate(([0], np.cumsum(counts)))
    inside = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    starts = np.repeat(offsets[:-1], counts) + inside * STEP
    ends = np.repeat(offsets[1:], counts)
    features = np.empty((len(starts), FILTERS), np.float32)
    for k in range(0, len(starts), CHUNKS_AT_ONCE):
        part = slice(k, k + CHUNKS_AT_ONCE)
        features[part] = pooled(network, chunks_of(data, starts[part], ends[part]))
    mean = np.add.reduceat(features.astype(np.float64), first[:-1], axis=0) / counts[:, None]
    most = np.maximum.reduceat(features, first[:-1], axis=0)
    logit = np.concatenate((mean, most), axis=1) @ network.unit + network.offset[0]
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit(sample: list[tuple[bytes, int]], rate: float | None = None, seed: int = 7) -> Network:
    """Learns from (text, 0 or 1) with Adam. Without both labels the result is a constant.

    `rate` is the true share of label 1 where the sample's differs; the log odds are shifted by the difference.
    """
    draw = np.random.default_rng(seed)
    scale = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
    network = Network(scale(256, DEPTH), scale(WIDTH * DEPTH, FILTERS) / 2, np.zeros(FILTERS, np.float32), scale(2 * FILTERS), np.zeros(1, np.float32))
    labels = np.array([label for _, label in sample], np.float32)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    network.offset[0] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        network.unit[:] = 0
        return network
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    batches = -(-len(sample) // BATCH)
    for turn in range(EPOCHS * batches):
        if turn % batches == 0:
            order = draw.permutation(len(sample))
        chosen = order[turn % batches * BATCH :][:BATCH]
        gradients = _gradients(network, [sample[i][0] for i in chosen], labels[chosen])
        step = RATE * (1 - turn / (EPOCHS * batches))
        for value, gradient, (mean, square) in zip(network.parameters(), gradients, moments):
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            value -= step * (mean / (1 - 0.9 ** (turn + 1))) / (np.sqrt(square / (1 - 0.99 ** (turn + 1))) + 1e-6)
    if rate is not None and 0 < rate < 1:
        own = float(labels.mean(dtype=np.float64))
        network.offset[0] += np.log(rate / (1 - rate)) - np.log(own / (1 - own))
    return network


def _gradients(network: Network, batch: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss; max-pooling passes them to one window per chunk and filter."""
    lengths = np.array([len(text) for text in batch])
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    counts = chunk_counts(lengths)
    first = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(batch)), counts)
    starts = offsets[owner] + (np.arange(first[-1]) - first[owner]) * STEP
    chunks = chunks_of(np.frombuffer(b"".join(batch), np.uint8), starts, offsets[owner + 1])
    best, values = [], []
    for k in range(0, len(chunks), CHUNKS_AT_ONCE):
        out = convolve(network, chunks[k : k + CHUNKS_AT_ONCE])
        best.append(out.argmax(axis=1))
        values.append(out.max(axis=1))
    best, features = np.concatenate(best), np.maximum(np.concatenate(values) + network.bias, 0)
    mean = np.add.reduceat(features, first[:-1], axis=0) / counts[:, None]
    most = np.maximum.reduceat(features, first[:-1], axis=0)
    both = np.concatenate((mean, most), axis=1)
    error = (1 / (1 + np.exp(-np.clip(both @ network.unit + network.offset[0], -50, 50))) - labels) / len(batch)
    unit = error @ both + 1e-4 * network.unit
    back = error[owner, None] * network.unit[:FILTERS] / counts[owner, None]
    ties = features == most[owner]
    back += np.where(ties, error[owner, None] * network.unit[FILTERS:], 0) / np.add.reduceat(ties.astype(np.float64), first[:-1], axis=0)[owner]
    back = np.where(features > 0, back, 0).astype(np.float32)
    evens = CHUNK // WIDTH
    place = np.where(best < evens, best * WIDTH, (best - evens) * WIDTH + STRIDE)
    windows = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
    embedded = network.embedding[windows].reshape(len(chunks), FILTERS, -1)
    filters = np.einsum("cf,cfk->kf", back, embedded)
    embedding = np.zeros_like(network.embedding)
    np.add.at(embedding, windows, back[:, :, None, None] * network.filters.T.reshape(FILTERS, WIDTH, DEPTH))
    return [embedding, filters, back.sum(axis=0), unit.astype(np.float32), error.sum(keepdims=True).astype(np.float32)]


def predict(docs: DataFrame, network: Network, text: str = "text", result: str = "score") -> DataFrame:
    """Adds the probability of label 1 for each whole text, however long; null counts as empty, and empty texts have a score too.

    Rows, repeated ones too, and other columns stay; a column that already has the result's name is replaced. An empty
    table stays empty.
    """

    @arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        data, offsets = buffer(column)
        scores = np.empty(len(column), np.float64)
        for start, stop in slices(offsets):
            scores[start:stop] = score(network, data, offsets[start : stop + 1])
        return pa.array(scores)

    return docs.withColumn(result, run(F.col(text)))

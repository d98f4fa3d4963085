"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; filters run over ``WIDTH`` bytes every ``STRIDE`` bytes; half-chunks of ``HALF`` bytes keep each filter's maximum and
mean; a chunk is two neighbouring halves, so chunks overlap by half and cover the whole text; a hidden layer looks at
each chunk, and its maxima over all chunks make one probability.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.labelled import labelled_texts
from turnwise.llm.tasks import annotate
from turnwise.llm.words import arrow_bytes

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 6, 2, 24, 16
HALF = 128
STEPS = HALF // STRIDE  # filter positions in a half-chunk
SAMPLE = 2000  # labelled documents learned from at most
UPDATES, BATCH, RATE = 560, 32, 0.005  # however many documents there are to learn from
TILE = 64  # halves convolved at once


def layout(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in whole halves, filled up with zero bytes (one at least), and the n + 1 offsets of their halves."""
    size = np.diff(at)
    halves = size // HALF + 1
    upto = np.concatenate(([0], np.cumsum(halves)))
    flat = np.zeros(upto[-1] * HALF, np.uint8)
    flat[np.repeat(upto[:-1] * HALF - at[:-1], size) + np.arange(at[0], at[-1])] = data[at[0] : at[-1]]
    return flat, upto


def chunk_pairs(upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half, second half, text) of every chunk; a text of one half is one chunk of it twice."""
    halves = np.diff(upto)
    first = np.arange(upto[-1])
    text = np.repeat(np.arange(len(halves)), halves)
    last = first == upto[1:][text] - 1
    use = ~last | (halves[text] == 1)
    first, last, text = first[use], last[use], text[use]
    return first, np.where(last, first, first + 1), text


def beyond(upto: np.ndarray, steps: int) -> np.ndarray:
    """Positions from which ``steps`` further on is past the end of the text, where filters see zeros."""
    return (upto[1:, None] * STEPS - 1 - np.arange(steps)).reshape(-1)


@dataclass
class Network:
    embed: np.ndarray  # byte by EMBED; the byte 0 also fills up
    filters: np.ndarray  # WIDTH * EMBED by FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 * FILTERS by HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    shift: float = 0.0  # from the sample's share of labels to that of all

    @classmethod
    def fresh(cls, random: np.random.Generator) -> Network:
        def normal(*shape, scale):
            return (random.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            normal(256, EMBED, scale=0.5),
            normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5 * 1.5),
            np.zeros(FILTERS, np.float32),
            normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5 * 1.5),
            np.zeros(HIDDEN, np.float32),
            normal(HIDDEN, scale=0.3),
            np.zeros(1, np.float32),
        )

    @classmethod
    def constant(cls, share: float) -> Network:
        """Gives every text the same score."""
        network = cls.fresh(np.random.default_rng(0))
        network.out[:] = 0
        network.shift = float(np.log(share / (1 - share)))
        return network

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def pieces(self, flat: np.ndarray) -> np.ndarray:
        """Embedded bytes, ``STRIDE`` of them a row; the last rows are zeros past the end."""
        padded = np.concatenate([flat, np.zeros(WIDTH - STRIDE, np.uint8)])
        return self.embed[padded].reshape(-1, STRIDE * EMBED)

    def convolve(self, pieces: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Filter values at every position."""
        n, span = len(pieces) - (WIDTH // STRIDE - 1), STRIDE * EMBED
        zeros = np.tile(self.embed[0], STRIDE)
        out = pieces[:n] @ self.filters[:span]
        for j in range(1, WIDTH // STRIDE):
            weight = self.filters[j * span : (j + 1) * span]
            more = pieces[j : j + n] @ weight
            more[beyond(upto, j)] = zeros @ weight
            out += more
        out += self.bias
        return np.maximum(out, 0, out=out)

    def tables(self) -> list[np.ndarray]:
        """What each ``STRIDE`` bytes (as a little-endian number) add to every filter, by their place in its window."""
        numbers = np.arange(256**STRIDE, dtype=np.uint32)
        pieces = np.concatenate([self.embed[(numbers >> (8 * i)) & 255] for i in range(STRIDE)], axis=1)
        span = STRIDE * EMBED
        out = [pieces @ self.filters[j * span : (j + 1) * span] for j in range(WIDTH // STRIDE)]
        out[0] += self.bias
        return out

    def halves(self, flat: np.ndarray, upto: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Maxima and means of the filters for each half; filters see on into the next half, as a text goes on."""
        n = len(flat) // HALF
        numbers = [flat.view(f"<u{STRIDE}")]
        for k in range(1, len(tables)):
            numbers.append(np.concatenate([numbers[0][k:], np.zeros(k, numbers[0].dtype)]))
            numbers[k][beyond(upto, k)] = 0
        out = np.empty((n, 2 * FILTERS), np.float32)
        for lo in range(0, n, TILE):
            hi = min(n, lo + TILE)
            i, j = lo * STEPS, hi * STEPS
            values = np.take(tables[0], numbers[0][i:j], axis=0)
            for k in range(1, len(tables)):
                values += np.take(tables[k], numbers[k][i:j], axis=0)
            np.maximum(values, 0, out=values)
            values = values.reshape(hi - lo, STEPS, FILTERS)
            out[lo:hi, :FILTERS] = values.max(axis=1)
            out[lo:hi, FILTERS:] = np.einsum("hsf->hf", values) / STEPS
        return out

    def hidden_values(self, flat: np.ndarray, upto: np.ndarray, first: np.ndarray, second: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Of every chunk."""
        halves = self.halves(flat, upto, tables)
        features = np.concatenate(
            [np.maximum(halves[first, :FILTERS], halves[second, :FILTERS]), (halves[first, FILTERS:] + halves[second, FILTERS:]) / 2], axis=1
        )
        return np.maximum(features @ self.hidden + self.hidden_bias, 0)

    def score(self, data: np.ndarray, at: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Probability of label 1 for each text."""
        flat, upto = layout(data, at)
        first, second, text = chunk_pairs(upto)
        hidden = self.hidden_values(flat, upto, first, second, tables or self.tables())
        pooled = np.maximum.reduceat(hidden, np.searchsorted(text, np.arange(len(upto) - 1)), axis=0)
        logit = pooled @ self.out + self.out_bias + self.shift
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, flat: np.ndarray, upto: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss of a batch of whole texts. The forward pass takes all chunks, as scoring does; what goes back goes
        through the chunks that hold a text's hidden values, ``HIDDEN`` of a text at most, so memory follows the number of texts."""
        span = STRIDE * EMBED
        first, second, text = chunk_pairs(upto)
        hidden = self.hidden_values(flat, upto, first, second, self.tables())
        pooled = np.maximum.reduceat(hidden, np.searchsorted(text, np.arange(len(label))), axis=0)
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.out_bias)))
        d_logit = ((p - label) / len(label)).astype(np.float32)
        # Each text's hidden value comes from the first chunk that reaches it.
        reached = (hidden == pooled[text]) & (hidden > 0)
        holders = []
        for h in range(HIDDEN):
            hit = np.flatnonzero(reached[:, h])
            texts, at = np.unique(text[hit], return_index=True)
            holders.append((hit[at], texts))
        chosen = np.unique(np.concatenate([[0], *[hit for hit, _ in holders]]).astype(np.int64))
        d_hidden = np.zeros((len(chosen), HIDDEN), np.float32)
        for h, (hit, texts) in enumerate(holders):
            d_hidden[np.searchsorted(chosen, hit), h] = d_logit[texts] * self.out[h]
        # The chosen chunks, each with the half that its filters see on into.
        begin, wide = first[chosen], second[chosen] - first[chosen]
        size = np.minimum(begin + wide + 2, upto[1:][text[chosen]]) - begin
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = flat.reshape(-1, HALF)[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])].reshape(-1)
        first, second = upto[:-1], upto[:-1] + wide
        n = len(flat) // STRIDE
        padded = np.concatenate([flat, np.zeros(WIDTH - STRIDE, np.uint8)])
        pieces = self.pieces(flat)
        values = self.convolve(pieces, upto).reshape(-1, STEPS, FILTERS)
        top = values.argmax(axis=1)
        most, mean = np.take_along_axis(values, top[:, None], 1)[:, 0], values.mean(axis=1)
        left = most[first] >= most[second]
        features = np.concatenate([np.where(left, most[first], most[second]), (mean[first] + mean[second]) / 2], axis=1)
        d_features = d_hidden @ self.hidden.T
        d_most, d_mean = np.zeros_like(most), np.zeros_like(mean)
        part = d_features[:, :FILTERS]
        # A half is the first of one chunk at most, and the second of one.
        d_most[first] += np.where(left, part, 0)
        d_most[second] += np.where(left, 0, part)
        for half in (first, second):
            d_mean[half] += d_features[:, FILTERS:] / 2
        d_values = np.repeat(d_mean[:, None] / STEPS, STEPS, axis=1).astype(np.float32)
        np.put_along_axis(d_values, top[:, None], np.take_along_axis(d_values, top[:, None], 1) + d_most[:, None], 1)
        d_values = (d_values * (values > 0)).reshape(n, FILTERS)
        d_filters, d_pieces, d_embed = [], np.zeros_like(pieces), np.zeros_like(self.embed)
        zeros = np.tile(self.embed[0], STRIDE)
        for j in range(WIDTH // STRIDE):
            weight, past = self.filters[j * span : (j + 1) * span], beyond(upto, j)
            d_past = d_values[past]
            inside = d_values.copy()
            inside[past] = 0
            d_filters.append(pieces[j : j + n].T @ inside + np.outer(zeros, d_past.sum(axis=0)))
            d_pieces[j : j + n] += inside @ weight.T
            d_embed[0] += (d_past @ weight.T).reshape(-1, EMBED).sum(axis=0)
        d_bytes = d_pieces.reshape(-1, EMBED)
        for e in range(EMBED):
            d_embed[:, e] += np.bincount(padded, weights=d_bytes[:, e], minlength=256)
        return [d_embed, np.concatenate(d_filters), d_values.sum(axis=0), features.T @ d_hidden, d_hidden.sum(axis=0), pooled.T @ d_logit, d_logit.sum(keepdims=True)]


def fit(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 5, updates: int = UPDATES) -> Network:
    """Adam on batches in random order. ``share`` is the part of label 1 among all labels, which the sample need not have."""
    random = np.random.default_rng(seed)
    network = Network.fresh(random)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    step = 0
    while step < updates:
        order = random.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            if step == updates:
                break
            mine = order[lo : lo + BATCH]
            parts = [texts[i] for i in mine]
            at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            flat, upto = layout(np.frombuffer(b"".join(parts), np.uint8), at)
            step += 1
            rate = RATE * min(1.0, step / 50) * (1 - 0.9 * step / updates)
            for weight, gradient, (m, v) in zip(network.weights(), network.gradients(flat, upto, labels[mine]), moments):
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient * gradient - v)
                weight -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    own = labels.mean()
    network.shift = float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return network


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, updates: int = UPDATES) -> Network:
    """Learns from all bytes of at most ``sample`` labelled documents, in one task, where numpy keeps to the task's core. With fewer than two
    labels, every score is the share of label 1."""
    texts, counts = labelled_texts(docs, labels, "quality", learn, sample)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    if not counts.get(0) or not counts.get(1):
        return Network.constant(share)
    rows = texts.select("doc_id", "label", F.col("text").cast("binary").alias("text"))

    def run(batches):
        held = sorted(((r["doc_id"], r["label"], r["text"] or b"") for batch in batches for r in batch.to_pylist()), key=lambda r: r[0])
        found = np.array([r[1] for r in held], np.float32)
        if len(held) and found.min() < found.max():
            network = fit([r[2] for r in held], found, share, updates=updates)
        else:  # the labels' documents are not all there
            network = Network.constant(share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "network binary").first().network)


def score_quality(docs: DataFrame, network: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of a document's columns) and ``score`` (0 to 1, higher: label 1 likelier), from all bytes of the text.

    A null text is scored as an empty one, which is one chunk of zeros. Repeated rows get equal scores; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def begin():
        network = shared.value
        tables = network.tables()

        def step(column):
            data, at = arrow_bytes(column)
            return [pa.array(network.score(data, at, tables))]

        return step

    return annotate(docs, text, begin, "score double", keep)

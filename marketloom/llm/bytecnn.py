"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are covered by overlapping chunks. In each chunk, learned filters slide over
embedded bytes and keep their largest response (max-pooling). The chunk vectors of a document are
combined by their largest, mean and smallest values into one hidden layer and one probability.

Fitting takes a bounded sample: at most ``sample_docs`` labelled documents of each class (the least
by hash of the id) and at most ``train_chunks`` chunks of each in a pass, drawn anew in every pass, so
that one very long document does not fill a batch; the sample is all that the driver holds. Scoring reads every byte of every document. Only bytes are inputs.

Null and empty texts score 0. With no labelled row, or one class only, the score of other texts is
the share of label 1 (0.5 without labels). Equal texts get equal scores. Only doc_id, text and quality
are read, whatever other columns are named. Empty tables give no rows. A very long text is scored from
all its chunks, held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 256


@dataclass(frozen=True)
class Shape:
    chunk: int = 512
    overlap: int = 32
    width: int = 8
    stride: int = 4
    embedding: int = 4
    filters: int = 32
    hidden: int = 16


def chunks_of(data: bytes, shape: Shape) -> np.ndarray:
    """All overlapping chunks of a document as rows of byte codes; the last one is padded."""
    step = shape.chunk - shape.overlap
    n = max(1, -(-(len(data) - shape.overlap) // step))
    codes = np.full((n - 1) * step + shape.chunk, PAD, np.int16)
    codes[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(codes, shape.chunk)[::step]


@dataclass
class Network:
    shape: Shape
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.5  # share of label 1 among labelled rows
    shift: float = 0.0  # from the sample's share of label 1 to the prior's

    @staticmethod
    def fresh(shape: Shape, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        fan = shape.width * shape.embedding
        make = lambda *size, scale: (rng.standard_normal(size) * scale).astype(np.float32)
        weights = {
            "bytes": make(257, shape.embedding, scale=0.5),
            "filters": make(fan, shape.filters, scale=(2 / fan) ** 0.5),
            "filter_bias": np.zeros(shape.filters, np.float32),
            "hidden": make(3 * shape.filters, shape.hidden, scale=(2 / (3 * shape.filters)) ** 0.5),
            "hidden_bias": np.zeros(shape.hidden, np.float32),
            "out": make(shape.hidden, scale=(1 / shape.hidden) ** 0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        return Network(shape, weights)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        s = self.shape
        x = self.weights["bytes"][chunks]
        n, length, d = x.shape
        spots = (length - s.width) // s.stride + 1
        view = np.lib.stride_tricks.as_strided(x, (n, spots, s.width * d), (x.strides[0], s.stride * d * 4, 4))
        return view.reshape(n * spots, s.width * d)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Max-pooled responses of each chunk, where they were, and the windows."""
        w = self.windows(chunks)
        a = (w @ self.weights["filters"]).reshape(len(chunks), -1, self.shape.filters)
        best = a.argmax(axis=1)
        top = np.take_along_axis(a, best[:, None], axis=1)[:, 0] + self.weights["filter_bias"]
        return np.maximum(top, 0), best, w

    def responses(self, chunks: np.ndarray, step: int = 64) -> np.ndarray:
        out = np.empty((len(chunks), self.shape.filters), np.float32)
        for i in range(0, len(chunks), step):
            part = chunks[i : i + step]
            a = (self.windows(part) @ self.weights["filters"]).reshape(len(part), -1, self.shape.filters)
            out[i : i + step] = a.max(axis=1)
        return np.maximum(out + self.weights["filter_bias"], 0)

    def logit(self, document: np.ndarray) -> np.ndarray:
        h = np.maximum(document @ self.weights["hidden"] + self.weights["hidden_bias"], 0)
        return h @ self.weights["out"] + self.weights["out_bias"][0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            m = self.responses(np.concatenate([c for _, c in held]))
            starts = np.cumsum([0, *[len(c) for _, c in held[:-1]]])
            out[[k for k, _ in held]] = self.probability(combined(m, starts))
            held.clear()

        for k, text in enumerate(texts):
            if text:
                if not self.weights:
                    out[k] = self.prior
                    continue
                held.append((k, chunks_of(text.encode(), self.shape)))
                size += len(held[-1][1])
                if size > 2048:
                    flush()
                    size = 0
        if held:
            flush()
        return out

    def probability(self, documents: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(documents).astype(float) + self.shift, -30, 30)))


def combined(m: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff([*starts, len(m)])[:, None]
    parts = [np.maximum.reduceat(m, starts), np.add.reduceat(m, starts) / sizes, np.minimum.reduceat(m, starts)]
    return np.concatenate(parts, axis=1).astype(np.float32)


def gradients(net: Network, chunks: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of a batch of documents, whose chunks begin at ``starts``."""
    s, w = net.shape, net.weights
    m, best, windows = net.pooled(chunks)
    doc = combined(m, starts)
    pre = doc @ w["hidden"] + w["hidden_bias"]
    h = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ w["out"] + w["out_bias"][0], -30, 30)))
    d_out = ((p - labels) / len(labels)).astype(np.float32)
    d_pre = np.outer(d_out, w["out"]) * (pre > 0)
    d_doc = d_pre @ w["hidden"].T
    f = s.filters
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(m)]))
    sizes = np.bincount(owner).astype(np.float32)[:, None]
    d_m = (d_doc[:, f : 2 * f] / sizes)[owner]
    for part, extreme in ((d_doc[:, :f], doc[:, :f]), (d_doc[:, 2 * f :], doc[:, 2 * f :])):
        hit = m == extreme[owner]
        ties = np.add.reduceat(hit, starts, axis=0, dtype=np.float32)
        d_m += hit * (part / ties)[owner]
    d_m *= m > 0
    spots = windows.shape[0] // len(chunks)
    rows = np.arange(len(chunks))[:, None] * spots + best
    d_filters = np.einsum("nf,nfk->kf", d_m, windows[rows])
    d_bytes = np.zeros_like(w["bytes"])
    at = best[:, :, None] * s.stride + np.arange(s.width)
    codes = chunks[np.arange(len(chunks))[:, None, None], at]
    back = d_m[:, :, None, None] * w["filters"].T.reshape(f, s.width, s.embedding)
    for k in range(s.embedding):
        d_bytes[:, k] = np.bincount(codes.ravel(), back[..., k].ravel(), minlength=257)
    return {
        "bytes": d_bytes,
        "filters": d_filters,
        "filter_bias": d_m.sum(axis=0),
        "hidden": doc.T @ d_pre,
        "hidden_bias": d_pre.sum(axis=0),
        "out": h.T @ d_out,
        "out_bias": d_out.sum(keepdims=True),
    }


def fit(
    texts: list[str], labels: np.ndarray, prior: float, shape: Shape = Shape(), passes: int = 24_000, batch: int = 32, rate: float = 4e-3, train_chunks: int = 16, seed: int = 7
) -> Network:
    """Adam on the logistic loss; the sample's share of label 1 is corrected to ``prior`` afterwards.

    Each document is seen 8 to 30 times, so that about ``passes`` are made in all.
    """
    kept = [k for k, t in enumerate(texts) if t]
    labels = np.asarray(labels, np.float32)[kept]
    if len(set(labels.tolist())) < 2:
        return Network(shape, prior=prior)
    net, rng = Network.fresh(shape, seed), np.random.default_rng(seed)
    data = [chunks_of(texts[k].encode(), shape) for k in kept]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    epochs = min(30, max(8, passes // max(1, len(data))))
    step, total = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            picked = order[i : i + batch]
            parts = [d if len(d := data[k]) <= train_chunks else d[rng.choice(len(d), train_chunks, replace=False)] for k in picked]
            starts = np.cumsum([0, *map(len, parts[:-1])])
            grads = gradients(net, np.concatenate(parts), starts, labels[picked])
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step / total))
            for k, g in grads.items():
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                net.weights[k] -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    share = float(labels.mean())
    net.prior = prior
    bounded = min(max(prior, 1e-3), 1 - 1e-3)
    net.shift = float(np.log(bounded / (1 - bounded)) - np.log(share / (1 - share)))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = 1500, shape: Shape = Shape()) -> Network:
    """Fit on ``doc_id, text`` and ``doc_id, quality``; rows with null ids or labels are left out.

    Of several labels of one doc_id the larger counts. The sample holds at most ``2 * sample_docs``
    doc_ids and ``4 * sample_docs`` rows, whatever the size of the tables; of repeated ids the rows least by the hash
    of their text count.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    picked = None
    for label in (0, 1):
        part = marked.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * sample_docs rows
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = sorted(((r["doc_id"], r["text"], r["quality"]) for r in sample.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(4 * sample_docs).collect()), key=lambda r: (r[0], r[1]))
    return fit([t for _, t, _ in rows], np.array([q for _, _, q in rows]), prior, shape)


def quality_score(text: Column, net: Network) -> Column:
    """The probability of label 1 for each whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(net.score(texts.tolist()))

    return score(text.cast("string"))

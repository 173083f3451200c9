"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters of 8 bytes run over chunks of 64 bytes
that overlap by half and cover the whole document. A filter's value in a chunk
is its mean positive response there; the largest over all chunks is pooled, and
a logistic layer combines the pooled values into one probability. At scoring
time embedding and filters are folded into one table per place in the filter,
so that a response is a sum of gathered rows.

The network is fitted on the driver on a bounded sample of labelled rows
(``SAMPLE_DOCS`` documents of at most ``SAMPLE_BYTES`` bytes, those of least
hash); every document is scored in full, in blocks of bounded memory.

Nulls and edge cases: null and empty texts are scored as one chunk of padding;
label rows without id or quality are left out, an id with both labels counts
as 0; without labels of both kinds the score is the share of label 1 (0.5
without any); repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, frugal, in_pieces, texts_of

#: Bounds of what the network is fitted on.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 16384
#: A filter sees WIDTH bytes and moves by STEP; a chunk holds 2 hops of HOP steps, and chunks overlap by a hop.
WIDTH, STEP, HOP = 8, 4, 8
EMBED, FILTERS, EPOCHS, BATCH, RATE = 8, 16, 8, 32, 0.01
#: Label 0 is the rarer; its rows count so many times.
WEIGHT_0 = 2.0
#: Steps whose responses are in memory at a time, and bytes of text in a piece of a batch.
BLOCK, GROUP_BYTES = 1 << 15, 1 << 20


def to_cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (byte + 1, 0 for padding) in rows of STEP, and each document's number of hops (2 at least)."""
    n = np.array([len(t) for t in texts], np.int64)
    hops = np.maximum(2, -(-n // (STEP * HOP)))
    flat = np.zeros(int(hops.sum()) * STEP * HOP, np.int16)
    at = 0
    for t, h in zip(texts, hops.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        flat[at : at + len(t)] += 1
        at += h * STEP * HOP
    return flat.reshape(-1, STEP), hops


def responses(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Filter responses where two rows of bytes meet."""
    left = table[0][cells[:-1, 0]]
    for w in range(1, STEP):
        left += table[w][cells[:-1, w]]
    for w in range(STEP):
        left += table[STEP + w][cells[1:, w]]
    return left


def chunks(cells: np.ndarray, hops: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean positive response by chunk; the chunk at a document's last hop is -inf."""
    sums = np.empty((len(cells) // HOP, len(bias)), np.float32)
    last = np.cumsum(hops) * HOP - 1
    padded = np.concatenate([cells, np.zeros((1, STEP), cells.dtype)])
    for at in range(0, len(cells), BLOCK):
        z = responses(padded[at : at + BLOCK + 1], table)
        z += bias
        np.maximum(z, 0, out=z)
        z[last[(last >= at) & (last < at + len(z))] - at] = 0  # no filter reaches into the next document
        sums[at // HOP : (at + len(z)) // HOP] = z.reshape(-1, HOP, z.shape[1]).sum(axis=1)
    sums[:-1] += sums[1:]
    sums /= 2 * HOP
    sums[(last + 1) // HOP - 1] = -np.inf
    return sums


def pooled(texts: list[bytes], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Largest chunk value by document and filter."""
    cells, hops = to_cells(texts)
    return np.maximum.reduceat(chunks(cells, hops, table, bias), np.cumsum(hops) - hops, axis=0)


def top(m: np.ndarray, v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Probability of label 1 from pooled values."""
    return 1 / (1 + np.exp(-np.clip(m @ v + c, -30, 30)))


class Network:
    """Parameters: embedding, filters, their bias, output weights and bias."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (257, EMBED)), "k": r.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
            "b": np.zeros(FILTERS), "v": r.normal(0, 0.3, FILTERS), "c": np.zeros(1),
        }
        self.p["e"][0] = 0
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.t = 0

    def table(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.p["e"], self.p["k"]).astype(np.float32)

    def weights(self) -> tuple[np.ndarray, ...]:
        return self.table(), self.p["b"].astype(np.float32), self.p["v"], self.p["c"]

    def step(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """One Adam step; the gradient reaches only the chunks that won the pooling."""
        table, p = self.table(), self.p
        bias = p["b"].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for cells, label in zip(docs, y, strict=True):
            value = chunks(cells, np.array([len(cells) // HOP]), table, bias)
            won = value.argmax(axis=0)
            m = value[won, np.arange(FILTERS)]
            d = (top(m[None], p["v"], p["c"])[0] - label) * (WEIGHT_0 if label == 0 else 1.0)
            g["v"] += d * m
            g["c"] += d
            at = np.minimum(won * HOP + np.arange(2 * HOP)[:, None], len(cells) - 2)  # the steps of each filter's chunk
            x = np.concatenate([cells[at], cells[at + 1]], axis=2)  # step, filter, byte
            z = p["b"] + sum(table[w][x[:, :, w], np.arange(FILTERS)] for w in range(WIDTH))
            dz = np.where(z > 0, d * p["v"] / (2 * HOP), 0.0)
            g["b"] += dz.sum(axis=0)
            g["k"] += np.einsum("sfwe,sf->wef", p["e"][x], dz)
            np.add.at(g["e"], x, np.einsum("wef,sf->sfwe", p["k"], dz))
        g["e"][0] = 0
        self.t += 1
        for k, v in p.items():
            a, b = self.m[k]
            gk = g[k] / len(docs)
            a += 0.1 * (gk - a)
            b += 0.001 * (gk * gk - b)
            v -= RATE * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.999**self.t)) + 1e-8)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    net, order = Network(seed), np.random.default_rng(seed)
    docs = [to_cells([t])[0] for t in texts]
    for _ in range(epochs):
        at = order.permutation(len(docs))
        for i in range(0, len(at), BATCH):
            net.step([docs[j] for j in at[i : i + BATCH]], labels[at[i : i + BATCH]])
    return net


def sample(documents: DataFrame, labels: DataFrame, folds: int, held: int) -> list:
    """(text, quality) of the bounded sample, outside the held-out fold."""
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold_of(folds) != held))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    )
    docs = documents.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    return docs.join(F.broadcast(one), "doc_id").orderBy("doc_id", "text").limit(2 * SAMPLE_DOCS).select("text", "quality").collect()


def fold_of(folds: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def scorer(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1):
    """A function that adds ``score`` to a frame with column ``text``."""
    rows = sample(documents, labels, folds, held)
    y = np.array([1.0 if r["quality"] == 1 else 0.0 for r in rows])
    net, constant = None, float(y.mean()) if len(y) else 0.5
    if len(y) and 0 < constant < 1:
        net = fit([r["text"].encode() for r in rows], y)
    shared = documents.sparkSession.sparkContext.broadcast(net.weights() if net else None)

    def add_score(docs: DataFrame) -> DataFrame:
        at = docs.columns.index("text")

        def run(batches: Batches) -> Batches:
            for batch in in_pieces(batches, at, GROUP_BYTES):
                out = np.full(batch.num_rows, constant)
                if shared.value:
                    table, b, v, c = shared.value
                    out = top(pooled(texts_of(batch.column(at)), table, b), v, c)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

        return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))

    return add_score


def classify(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = documents.select("doc_id", (fold_of(folds) == held).alias("held_out"), "text")
    scored = scorer(documents, labels, folds, held)(docs).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the network doesn't reject, all their columns."""
    own = documents.columns
    packed = documents.select("text", F.struct(*[F.col(c) for c in own]).alias("row"))
    return scorer(documents, labels)(packed).where("score >= 0.5").select("row.*")

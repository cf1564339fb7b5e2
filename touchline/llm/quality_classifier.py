"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Words hash into ``BUCKETS`` buckets, each with a sparse random index vector. A word vector is the sum of the index
vectors around its occurrences in the whole corpus, less the mean and scaled to length 1; the table of word vectors
has a fixed size. Documents are pooled over their whole text: mean over words, mean over distinct words, deviation,
and length. The network learns from at most ``TRAIN_ROWS`` labelled rows, the least by a hash, each with the same
weight, so that its probabilities follow the share of good rows. Of the rows held back, some pick the epoch, and others the
temperature that calibrates the probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS = 1 << 14
WIDTH = 48
NONZERO = 6
REACH = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
SEED = 9
#: Words worked on at once.
CHUNK = 60_000


def index_vectors(seed: int = SEED) -> np.ndarray:
    """Sparse random vectors of +1 and -1, one a bucket, and a zero row for gaps between documents."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + 1, WIDTH), dtype=np.float32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] = 1 if k % 2 else -1
    return out


def word_buckets(text: str | None) -> np.ndarray:
    """Buckets of a text's words in lower case."""
    words = (text or "").lower().encode().split()
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) % np.uint64(BUCKETS)).astype(np.int64)


def context_sums(docs: DataFrame) -> DataFrame:
    """bucket and WIDTH sums of index vectors within REACH words: at most BUCKETS rows."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = index_vectors()
        total = np.zeros((BUCKETS + 1, WIDTH))
        gap = np.full(REACH, BUCKETS, dtype=np.int64)

        def add(ids: np.ndarray) -> None:
            for at in range(0, len(ids), CHUNK):
                lo, hi = max(0, at - REACH), min(len(ids), at + CHUNK + REACH)
                near = np.concatenate((gap, ids[lo:hi], gap)) if lo == 0 and hi == len(ids) else ids[lo:hi]
                e = index[near]
                around = np.zeros_like(e)
                for k in range(1, REACH + 1):
                    around[k:] += e[:-k]
                    around[:-k] += e[k:]
                own = slice(REACH if lo == 0 and hi == len(ids) else at - lo, None)
                mine = near[own][: min(CHUNK, len(ids) - at)]
                around = around[own][: len(mine)]
                for d in range(WIDTH):
                    total[:, d] += np.bincount(mine, weights=around[:, d], minlength=BUCKETS + 1)

        for part in parts:
            held, n = [], 0
            for text in part["text"]:
                ids = word_buckets(text)
                held += [ids, gap]
                n += len(ids)
                if n > CHUNK:
                    add(np.concatenate(held))
                    held, n = [], 0
            if held:
                add(np.concatenate(held))
        hit = np.flatnonzero(np.abs(total[:BUCKETS]).sum(axis=1))
        yield pd.DataFrame(total[hit], columns=[f"v{d}" for d in range(WIDTH)]).assign(bucket=hit)

    names = [f"v{d}" for d in range(WIDTH)]
    sums = docs.select("text").mapInPandas(rows, ", ".join(f"{n} double" for n in names) + ", bucket long")
    return sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors by bucket. The driver reads BUCKETS rows of WIDTH numbers at most."""
    sums = context_sums(docs).toPandas()
    out = np.zeros((BUCKETS, WIDTH), dtype=np.float32)
    if len(sums):
        v = sums[[f"v{d}" for d in range(WIDTH)]].to_numpy()
        v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
        v = v - v.mean(axis=0)
        out[sums["bucket"].to_numpy()] = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    return out


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean over words, mean over distinct words, deviation, share of distinct words and log of the length."""
    if len(ids) == 0:
        return np.zeros(3 * WIDTH + 2, dtype=np.float32)
    kinds, counts = np.unique(ids, return_counts=True)
    v, share = vectors[kinds], counts[:, None] / len(ids)
    mean = (v * share).sum(axis=0)
    spread = np.sqrt(np.maximum((v * v * share).sum(axis=0) - mean * mean, 0))
    return np.concatenate((mean, v.mean(axis=0), spread, [len(kinds) / len(ids), np.log1p(len(ids)) / 8])).astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and x, the pooled vector, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x WIDTH numbers

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = [pooled(word_buckets(text), shared.value) for text in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "x": x})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, "doc_id long, x array<float>")


@dataclass
class Network:
    """Two layers over standardised features; a temperature divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED, epochs: int = 60) -> Network:
    """Fit by Adam on seven tenths of the rows; half of the rest picks the epoch, the other half the temperature."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    if len(np.unique(y)) < 2:  # nothing to tell apart: the share of good rows, or a half without any
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = rng.permutation(len(x))
    tenth = len(x) * 3 // 20
    held, apart, rest = order[:tenth], order[tenth : 2 * tenth], order[2 * tenth :]
    net = Network(x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3, rng.normal(0, (2 / n) ** 0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0

    def loss(rows: np.ndarray, temperature: float = 1.0) -> float:
        z = net.logit(x[rows]) / temperature
        return float(np.mean(np.logaddexp(0, z) - y[rows] * z))

    best, kept = np.inf, None
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(rest), max(1, len(rest) // 128)):
            a = (x[batch] - net.mean) / net.scale
            h = np.maximum(a @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[batch]) / len(batch)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = [a.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d, np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net.b2 = float(p[3][0])
        if len(held) and (now := loss(held)) < best:
            best, kept = now, [a.copy() for a in p]
    if kept:
        net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    if len(np.unique(y[apart])) == 2:
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: loss(apart, t)))
    return net


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def hash_cutoff(n: int, train_rows: int) -> int:
    """Of n ids, about 1.25 times ``train_rows`` have a 64-bit hash up to this one, or all."""
    share = min(1.0, 1.25 * train_rows / max(n, 1))
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    docs: doc_id, text; nothing else is read. labels: doc_id, quality (0 or 1; rows with another value, or null,
    teach nothing). Only rows whose crc32(doc_id as text) mod 3 is not 1 teach. A null or empty text is pooled to
    zeros and scored like any other. Repeated rows get the same score, and an id teaches once, by the least of its
    pooled vectors; a null doc_id is not held out. Without
    two classes to learn from, the score is the share of good rows, or a half. An empty docs gives no rows.
    """
    x = cut(features(docs, word_vectors(docs)))
    known = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    known = known.where(F.xxhash64("doc_id") <= hash_cutoff(known.count(), train_rows))
    # One row an id, and few more than ``train_rows`` of them before the limit, so the task that sorts them is bounded.
    taught = x.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).toPandas()
    rows = np.stack(taught["x"]) if len(taught) else np.zeros((0, 3 * WIDTH + 2))
    net = train(rows.astype(np.float64), taught["y"].to_numpy(dtype=np.float64))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(net.score(np.stack(x).astype(np.float64)) if len(x) else [], dtype="float64")

    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    scored = x.select("doc_id", held_out.alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document. Edges: see ``classify``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))

"""Toxicity by compression distance: two zstandard dictionaries, of ordinary and of toxic text, and windows of words.

The ordinary dictionary is trained by zstandard on windows of documents labelled as not toxic. The toxic one is that one
followed by what toxic documents have of their own: runs of letters that many of them share and ordinary ones hardly
have, the most frequent nearest to the end, where a reference to them is shortest. A window's distance is how many
bytes fewer it takes with the second dictionary than with the first. Windows are compressed behind a carrier, a stretch
that both dictionaries hold, so that a window of two words is not stored as it is and a single word tells. A window
that shares no five bytes in a row with the toxic part gains nothing to speak of by it and counts as 0.

A document is a histogram of the distances of all its windows. Labelled documents that took no part in the dictionaries
give the likelihood ratio of each distance, and calibrate the document's sum to a probability.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_key
from .quality_classifier import hash_cutoff, remainder

#: Most labelled rows that teach, windows of them that the ordinary dictionary is trained on, and pieces of words compared.
TRAIN_ROWS = 20_000
TRAIN_WINDOWS = 20_000
TRAIN_PIECES = 2_048
WINDOW_WORDS = 2
#: Bytes of the pieces of words that are compared, and of the shortest run that a window must share with the toxic part.
PIECES = (4, 5, 6, 7, 8)
NEAR = 5
#: A piece is toxic if it is in this share of the toxic documents at least, and in so many times the share of the ordinary ones.
SUPPORT = 0.03
CONTRAST = 20
LEAST_DOCUMENTS = 3
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 1_024
LIKE_BYTES = 4_096
#: Ordinary words that share so many bytes in a row with the toxic part are in the ordinary dictionary, whatever else is.
LIKE = 6
CARRIER_BYTES = 64
#: Stands between runs; no window holds it.
SEPARATOR = b"\n"
#: The last bytes of a dictionary are not searched by the compressor.
PADDING = b". \n" * 8
LEVEL = 16
LOW, HIGH = -3, 16
CUT = 0.7
#: Characters of a text that are worked on at once, and of texts whose pieces are counted before the counts are handed on.
PART = 1 << 20
COUNTED = 8 << 20
_OTHER = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def text_parts(text: str | None) -> Iterator[bytes]:
    """A text in lower case, its words between single spaces, in parts that end between words."""
    text, at = text or "", 0
    while at < len(text):
        end = min(at + PART, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        yield b" " + _OTHER.sub(b" ", text[at:end].lower().encode("utf-8", "replace")).strip() + b" "
        at = end


def windows(part: bytes) -> np.ndarray:
    """Where windows of WINDOW_WORDS words begin and end: they share the space between them."""
    gaps = np.flatnonzero(np.frombuffer(part, dtype=np.uint8) == 32)
    if len(part) <= 2:
        return np.zeros((0, 2), dtype=np.int64)
    ends = np.append(gaps[WINDOW_WORDS:-1:WINDOW_WORDS], gaps[-1])
    return np.stack((np.concatenate(([0], ends[:-1])), ends + 1), axis=1)


def sketch(text: str | None) -> list[int]:
    """Three least hashes of the text's runs of five words: near copies share one with a high chance."""
    words = [w for part in text_parts(text) for w in part.split()]
    runs = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
    return [min(xxhash.xxh64_intdigest(r, seed=seed) for r in runs) - (1 << 63) for seed in (1, 2, 3)]


def pieces(words: set[bytes]) -> set[bytes]:
    """The words, between spaces, and their runs of 4 to 8 bytes."""
    held = {b" " + w + b" " for w in words}
    return held | {w[k : k + n] for w in held for n in PIECES for k in range(len(w) - n + 1)}


def taught_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, text, toxic, fold (0: calibrates; else teaches): labelled rows, one an id, without the near copies of others.

    What is broadcast are labelled ids, not many more than ``train_rows``; texts meet them where they are read.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.xxhash64("doc_id") <= hash_cutoff(known.count(), train_rows))

    def sketched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys = [sketch(t) for t in part["text"]]
            yield part.drop(columns="text").assign(**{f"k{i}": [k[i] for k in keys] for i in range(3)})

    labelled = docs.join(F.broadcast(known), "doc_id").withColumn("version", text_key(F.col("text")))
    rows = labelled.mapInPandas(sketched, "doc_id long, toxic int, version long, k0 long, k1 long, k2 long")
    rows = cut(rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("version", "k0", "k1", "k2")).alias("s")).select("doc_id", "toxic", "s.*"))
    for k in ("k0", "k1", "k2"):  # of at most about ``train_rows`` rows, so a window's task is bounded
        rows = rows.withColumn("first", F.min("doc_id").over(Window.partitionBy(k))).where("doc_id = first")
    kept = cut(rows.select("doc_id", "toxic", "version"))
    texts = docs.withColumn("version", text_key(F.col("text"))).join(F.broadcast(kept), ["doc_id", "version"])
    once = texts.groupBy("doc_id", "toxic").agg(F.first("text").alias("text"))  # rows that repeat an id and text
    return cut(once.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(3))))


def toxic_pieces(taught: DataFrame) -> set[bytes]:
    """Pieces that many toxic documents have and few ordinary ones: TRAIN_PIECES at most, those of the most documents."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = {0: Counter(), 1: Counter()}, 0

        def told() -> pd.DataFrame:
            every = list(found[0].keys() | found[1].keys())
            return pd.DataFrame({"piece": every, "toxic": [found[1][p] for p in every], "ordinary": [found[0][p] for p in every]})

        for part in parts:
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                found[toxic].update(pieces({w for p in text_parts(text) for w in p.split()}))
                size += len(text or "")
                if size > COUNTED:  # what a task holds is bounded by the texts counted so far
                    yield told()
                    found, size = {0: Counter(), 1: Counter()}, 0
        yield told()

    n = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return set()
    sums = taught.select("text", "toxic").mapInPandas(counted, "piece binary, toxic long, ordinary long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    enough = F.col("toxic") >= max(LEAST_DOCUMENTS, SUPPORT * n[1])
    own = sums.where(enough & (F.col("toxic") * n[0] > CONTRAST * (F.col("ordinary") + 1) * n[1]))
    return {bytes(r["piece"]) for r in own.orderBy(F.desc("toxic"), "piece").limit(TRAIN_PIECES).collect()}


def toxic_run(word: bytes, own: set[bytes]) -> bytes:
    """The word, if it is one of ``own``, or what its pieces in ``own`` cover."""
    word = b" " + word + b" "
    if word in own:
        return word
    covered = np.zeros(len(word), dtype=bool)
    for n in PIECES:
        for k in range(len(word) - n + 1):
            if word[k : k + n] in own:
                covered[k : k + n] = True
    return bytes(np.frombuffer(word, dtype=np.uint8)[covered])


def most_common(rows: DataFrame, runs_of, most: int) -> bytes:
    """The runs of the most documents, ``most`` bytes of them, the most frequent last. runs_of: the runs of a set of words."""

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = Counter()
            for text in part["text"]:
                found.update(runs_of({w for p in text_parts(text) for w in p.split()}))
            yield pd.DataFrame({"run": list(found), "n": list(found.values())})

    sums = rows.select("text").mapInPandas(runs, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
    out = b""
    for r in sums.orderBy(F.desc("n"), "run").limit(most // PIECES[0]).collect():
        if len(out) + len(r["run"]) < most:
            out = SEPARATOR + bytes(r["run"]) + out
    return out


def toxic_part(taught: DataFrame, own: set[bytes]) -> bytes:
    """What toxic documents have of their own."""
    if not own:
        return b""
    return most_common(taught.where("toxic = 1"), lambda words: {r for w in words if (r := toxic_run(w, own))}, TOXIC_BYTES)


def like_toxic(taught: DataFrame, toxic: bytes) -> bytes:
    """Ordinary words that are much like toxic ones: no window gains by what these have in common."""
    known = {toxic[k : k + LIKE] for k in range(len(toxic) - LIKE + 1)}
    alike = lambda w: any(w[k : k + LIKE] in known for k in range(len(w) - LIKE + 1))
    return most_common(taught.where("toxic = 0"), lambda words: {w for x in words if alike(w := b" " + x[: LIKE_BYTES // 4] + b" ")}, LIKE_BYTES)


def ordinary_part(taught: DataFrame) -> bytes:
    """A dictionary trained on windows of ordinary documents, the TRAIN_WINDOWS of least hash."""

    def least(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes]] = []
        for part in parts:
            for text in part["text"]:
                for p in text_parts(text):
                    spans = windows(p)[:: WINDOW_WORDS * 2].tolist()  # wider ones, so that the dictionary holds whole phrases
                    spans = [(a, min(len(p), b + 24)) for a, b in spans]
                    held += [(xxhash.xxh64_intdigest(p[a:b]) >> 1, p[a:b]) for a, b in spans]
                if len(held) > 4 * TRAIN_WINDOWS:
                    held = heapq.nsmallest(TRAIN_WINDOWS, held)
        held = heapq.nsmallest(TRAIN_WINDOWS, held)
        yield pd.DataFrame(held, columns=["h", "window"])

    rows = taught.where("toxic = 0").select("text").mapInPandas(least, "h long, window binary")
    samples = [bytes(r["window"]) for r in rows.orderBy("h", "window").limit(TRAIN_WINDOWS).collect()]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(samples)[-ORDINARY_BYTES:]


class Compressors:
    """Both dictionaries, ready for use; made anew in each task from the bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        as_is = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.carrier = ordinary[len(ordinary) // 2 :][:CARRIER_BYTES]
        self.pair = []
        for content in (ordinary + PADDING, ordinary + toxic + PADDING):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, **as_is))
        self.bits = np.zeros(1 << 16, dtype=bool)
        own = np.frombuffer(toxic, dtype=np.uint8)
        if len(own) >= NEAR:
            self.bits[self.places(own)] = True
        self.seen: dict[bytes, int] = {}

    @staticmethod
    def places(data: np.ndarray) -> np.ndarray:
        """A 16-bit hash of the NEAR bytes from each place on."""
        n, total = len(data) - NEAR + 1, np.uint64(0)
        for k in range(NEAR):
            total = total | data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        return (total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def distance(self, window: bytes) -> int:
        if (known := self.seen.get(window)) is None:
            one, two = (len(c.compress(self.carrier + window)) for c in self.pair)
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[window] = min(max(one - two, LOW), HIGH)
        return known

    def histogram(self, text: str | None) -> np.ndarray:
        """How many of the text's windows have each distance, from LOW to HIGH."""
        out = np.zeros(HIGH - LOW + 1, dtype=np.int64)
        for part in text_parts(text):
            spans = windows(part)
            if len(spans):
                data = np.frombuffer(part, dtype=np.uint8)
                hit = self.bits[self.places(data)] if len(data) >= NEAR else np.zeros(0, dtype=bool)
                sums = np.concatenate(([0], np.cumsum(hit), np.full(NEAR, hit.sum())))
                near = spans[sums[np.maximum(spans[:, 1] - NEAR + 1, spans[:, 0])] > sums[spans[:, 0]]]
                out[-LOW] += len(spans) - len(near)
                for a, b in near.tolist():
                    out[self.distance(part[a:b]) - LOW] += 1
        return out


def histograms(docs: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """doc_id and h, the histogram, of every row."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = Compressors(ordinary, toxic)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "h": [pair.histogram(t) for t in part["text"]]})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, h array<long>")


@dataclass
class Calibration:
    """Log likelihood ratios of the distances, and a logistic curve over a document's sum, its size and its largest distance."""

    ratios: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def features(h: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        most = np.where(h > 0, np.arange(LOW, HIGH + 1), LOW).max(axis=1)
        return np.stack((h @ ratios, np.log1p(h.sum(axis=1)), np.log1p(h @ np.maximum(ratios, 0)), most), axis=1)

    def score(self, h: np.ndarray) -> np.ndarray:
        x = (self.features(h.astype(np.float64), self.ratios) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def calibrate(h: np.ndarray, y: np.ndarray) -> Calibration:
    """h: histograms of labelled rows that did not teach; y: their labels. With one class or none, every score is its share, or a half."""
    if len(np.unique(y)) < 2:
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Calibration(np.zeros(HIGH - LOW + 1), np.zeros(4), np.ones(4), np.array([0, 0, 0, 0, np.log(p / (1 - p))]))
    share = [h[y == k].sum(axis=0) + 0.5 for k in (0, 1)]
    ratios = np.log(share[1] / share[1].sum()) - np.log(share[0] / share[0].sum())
    x = Calibration.features(h, ratios)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, ridge = np.zeros(a.shape[1]), np.diag([1.0, 1, 1, 1, 1e-6])
    for _ in range(50):  # Newton's method; the ridge keeps it finite where the classes are apart
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
    return Calibration(ratios, mean, scale, w)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    docs: doc_id, text; nothing else is read. labels: doc_id, toxic (0 or 1; rows with another value, or null, teach
    nothing). Only rows whose crc32(doc_id as text) mod 3 is not 1 teach; an id teaches once, by the text of least hash, and of
    near copies one. A null or empty text has no windows and is scored as such. Repeated rows get the same score; a
    null doc_id is not held out. Without two classes to learn from, every score is the share of toxic rows, or a half.
    An empty docs gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    taught = taught_rows(docs, labels, train_rows)
    teaching = taught.where("fold > 0")
    toxic = toxic_part(teaching, toxic_pieces(teaching))
    ordinary = ordinary_part(teaching) + like_toxic(teaching, toxic)
    known = histograms(taught.where("fold = 0"), ordinary, toxic).join(taught.select("doc_id", "toxic"), "doc_id").orderBy("doc_id").toPandas()
    curve = calibrate(np.stack(known["h"]).astype(np.float64) if len(known) else np.zeros((0, HIGH - LOW + 1)), known["toxic"].to_numpy(dtype=np.float64))

    @F.pandas_udf("double")
    def score(h: pd.Series) -> pd.Series:
        return pd.Series(curve.score(np.stack(h)) if len(h) else [], dtype="float64")

    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    scored = histograms(docs, ordinary, toxic).select("doc_id", held_out.alias("held_out"), score("h").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document. Edges: see ``score_toxicity``."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))

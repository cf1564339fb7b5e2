"""Embedding near-dedup by random-hyperplane sign hashing in several tables.

Each vector gets, in each table, the signs of its products with a few random hyperplanes as a code; vectors of one
code are candidates. Codes are longer, and tables more, for more vectors, so that buckets of unrelated vectors stay
small and a pair at the threshold is missed with a chance under ``miss``. Codes travel without their vectors until
buckets of one row are gone; vectors then join the buckets that are left, many buckets to a task, one after another.
Candidates are verified by exact cosine in double precision. Equal vectors are one class from the start, with the
number of its vectors, so copies are never compared. A large bucket is cut into blocks, and pairs of blocks go to
different tasks. A pair that met in an earlier table is not counted again: vectors and hyperplanes are taken as whole
numbers, so that codes are exact and can be computed anew where they are needed; within two blocks, rectangles of vectors
that share an earlier code are passed over before any product is formed. A bucket returns a row per class, not per
pair: how many new links it has there, and one linked class of least id that it reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, components, cut, table

THRESHOLD = 0.9
MISS = 0.0005
SEED = 10
#: Vectors that share a code by chance, on average, and rows of a block of a bucket.
BUCKET_ROWS = 48
BLOCK_ROWS = 1024
#: Products that are formed without a look for earlier tables first.
PRODUCTS = 1 << 14
#: Steps of a component of a unit vector, and of a hyperplane, for the codes: products are whole numbers below 2 ** 53.
VECTOR_STEPS, PLANE_STEPS = 2.0**20, 2.0**10


def shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a code and number of tables for n vectors."""
    bits = max(4, round(math.log2(max(n, 1) / BUCKET_ROWS)) if n > BUCKET_ROWS else 4)
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    tables = 1 if agree >= 1 else math.ceil(math.log(miss) / math.log1p(-(agree**bits)))
    return bits, max(1, tables)


class Planes:
    """Codes of unit vectors. The hyperplanes follow from the seed, so every task makes the same ones."""

    def __init__(self, bits: int, tables: int, seed: int) -> None:
        self.bits, self.tables, self.seed = bits, tables, seed
        self.known: dict[int, np.ndarray] = {}

    def codes(self, x: np.ndarray, tables: int | None = None) -> np.ndarray:
        """A row a vector, a column for each of the first ``tables`` tables."""
        dim, tables = x.shape[1], self.tables if tables is None else tables
        if dim not in self.known:
            self.known[dim] = np.rint(PLANE_STEPS * np.random.default_rng([self.seed, dim]).standard_normal((dim, self.bits * self.tables)))
        signs = (np.rint(VECTOR_STEPS * x) @ self.known[dim][:, : self.bits * tables] > 0).reshape(len(x), tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def comparable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, raw (the components as bytes), dim of vectors that can be compared, each once; numpy's name of a component."""
    e, kind = F.col("embedding"), "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw = [np.asarray(x, dtype=kind).tobytes() for x in part["embedding"]]
            yield pd.DataFrame({"vec_id": part["vec_id"], "raw": raw})

    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.select(F.col("vec_id").cast("long"), "embedding").where(
        F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    )
    units = good.mapInPandas(rows, "vec_id long, raw binary").withColumn("dim", F.length("raw"))
    return units.distinct(), kind


def classes(units: DataFrame) -> DataFrame:
    """A row for each vector: raw, dim, key (a hash), vec_id (the least of its ids), and size, the number of its ids."""
    same = units.groupBy("raw", "dim").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    return same.withColumn("key", F.xxhash64("raw"))


def coded(units: DataFrame, kind: str, planes: Planes) -> DataFrame:
    """vec_id, key, dim, t, code: a row for each vector and table."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, all_of_dim in part.groupby("dim"):
                for at in range(0, len(all_of_dim), 1024):
                    few = all_of_dim.iloc[at : at + 1024]
                    code = planes.codes(unit(list(few["raw"]), kind))
                    each = {c: np.repeat(few[c].to_numpy(), planes.tables) for c in ("vec_id", "key")}
                    yield pd.DataFrame(each | {"dim": np.int32(dim), "t": np.tile(np.arange(planes.tables, dtype=np.int32), len(few)), "code": code.ravel()})

    return units.mapInPandas(rows, "vec_id long, key long, dim int, t int, code long")


def unmet(codes: np.ndarray, a: np.ndarray, b: np.ndarray, at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rectangles of places (a, b) that hold every pair which shares no earlier code: those of a table's commonest code are left out."""
    if not len(a) or not len(b):
        return
    if at == codes.shape[1] or len(a) * len(b) <= PRODUCTS:
        yield a, b
        return
    kinds, counts = np.unique(codes[a, at], return_counts=True)
    common = kinds[counts.argmax()]
    in_a, in_b = codes[a, at] == common, codes[b, at] == common
    if not in_b.any():
        yield from unmet(codes, a, b, at + 1)
        return
    yield from unmet(codes, a[in_a], b[~in_b], at + 1)
    yield from unmet(codes, a[~in_a], b, at + 1)


def bucket_links(
    ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, split: int, at: int, planes: Planes, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket in table ``at`` (or of two of its blocks, the second from ``split`` on), for the classes with links
    that no earlier table found: their places, the vectors linked to them so, and the least id reached by them."""
    within = split == len(ids)
    count, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    codes = planes.codes(x, at) if at and split * (len(ids) - (0 if within else split)) > PRODUCTS else None
    every = np.arange(len(ids))
    whole = (every[:split], every if within else every[split:])
    half = within and codes is None  # each pair once; in rectangles each way round is one end's link
    for rows, columns in unmet(codes, *whole) if codes is not None else [whole]:
        for lo in range(0, len(rows), 256):
            some, others = rows[lo : lo + 256], columns[lo:] if half else columns
            a, b = np.nonzero(x[some] @ x[others].T >= threshold)
            a, b = some[a], others[b]
            if within:
                keep = a < b if half else a != b
                a, b = a[keep], b[keep]
            if at and len(a):
                if codes is None:
                    linked, places = np.unique(np.concatenate((a, b)), return_inverse=True)
                    known, u, v = planes.codes(x[linked], at), places[: len(a)], places[len(a) :]
                else:
                    known, u, v = codes, a, b
                new = np.empty(len(a), dtype=bool)
                for k in range(0, len(a), 100_000):
                    new[k : k + 100_000] = ~(known[u[k : k + 100_000]] == known[v[k : k + 100_000]]).any(axis=1)
                a, b = a[new], b[new]
            if not len(a):
                continue
            count += np.bincount(a, weights=sizes[b], minlength=len(ids)).astype(np.int64)
            if half or not within:
                count += np.bincount(b, weights=sizes[a], minlength=len(ids)).astype(np.int64)
            while True:  # hook larger roots under smaller ones until each link's ends agree
                ra, rb = root[a], root[b]
                if (ra == rb).all():
                    break
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root != root[root]).any():
                    root = root[root]
    hit = np.flatnonzero(count)
    low = ids.copy()
    np.minimum.at(low, root[hit], ids[hit])
    return hit, count[hit], low[root[hit]]


def found_links(dealt: DataFrame, kind: str, planes: Planes, threshold: float) -> DataFrame:
    """vec_id, key, n, to for the rows of buckets: t, dim, code, i, j, block, vec_id, key, size, raw; buckets stand together and in order."""
    key, out = ["t", "dim", "code", "i", "j"], ["vec_id", "key", "n", "to"]

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """rows: whole buckets."""
        for _, same in rows.groupby("dim", sort=False):
            x, block = unit(list(same["raw"]), kind), same["block"].to_numpy()
            ids, sizes, keys = (same[c].to_numpy() for c in ("vec_id", "size", "key"))
            k = same[key].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1), [True])))
            got = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo > 1:
                    t, _, _, i, j = k[lo].tolist()
                    split = hi - lo if i == j else int(np.searchsorted(block[lo:hi], j))
                    hit, n, low = bucket_links(ids[lo:hi], sizes[lo:hi], x[lo:hi], split, t, planes, threshold)
                    got.append((ids[lo:hi][hit], keys[lo:hi][hit], n, low))
            if got:
                yield pd.DataFrame(dict(zip(out, map(np.concatenate, zip(*got, strict=True)), strict=True)))

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last bucket so far, which may go on
        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy() if len(rows) else np.zeros(0, dtype=bool)
            yield from links(rows[~last])
            held = rows[last]
        if held is not None:
            yield from links(held)

    placed = dealt.repartition(*key).sortWithinPartitions(*key, "block")
    return placed.select(*key, "block", "vec_id", "key", "size", "raw").mapInPandas(stream, "vec_id long, key long, n long, to long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (array of float or double); other columns are ignored. Linked: two vectors of
    different ids and equal length with a cosine of at least ``threshold``. Vectors that are null, empty, zero or
    hold null or non-finite components are linked with nothing. n_links is the number of other vectors linked
    directly; component_id the least vec_id reachable; kept: that is its own. Rows that repeat an id and vector
    count as one vector and each get its result; vectors that share an id but differ are vectors of their own, whose links
    are added up and whose components are one. Each row without an id has no link, a null component, and is kept. An
    empty vectors gives no rows.
    """
    units, kind = comparable(vectors)
    units = cut(units)
    all_classes = cut(classes(units))
    planes = Planes(*shape(all_classes.count(), threshold, miss), seed)
    posts = cut(coded(all_classes, kind, planes))
    sized = attach(posts, ["t", "dim", "code"], "vec_id", {"rows": (F.sum, F.lit(1))}).where("rows > 1")
    dealt = sized.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS)).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("blocks")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("vec_id", "key", "t", "dim", "code", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    found = cut(found_links(dealt.join(all_classes.drop("dim"), ["vec_id", "key"]), kind, planes, threshold))
    counts = found.groupBy("vec_id", "key").agg(F.sum("n").alias("n"))
    linked = all_classes.join(counts, ["vec_id", "key"], "left")
    told = linked.select("key", "raw", F.col("vec_id").alias("least"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    members = cut(units.withColumn("key", F.xxhash64("raw")).join(told, ["key", "raw"]).select("vec_id", "least", "n_links"))
    several = members.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("least").alias("least"), F.max("least").alias("most"))
    same_id = members.join(several.where("least <> most").select("vec_id"), "vec_id").select("vec_id", F.col("least").alias("to"))
    ends = found.select("vec_id", "to").unionByName(same_id).where(F.col("vec_id") != F.col("to"))
    groups = components(ends, "vec_id", "to").withColumnRenamed("node", "least")
    result = vectors.select(F.col("vec_id").cast("long")).join(several.drop("most"), "vec_id", "left").join(groups, "least", "left")
    component = F.coalesce("component", "least", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings. Edges: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

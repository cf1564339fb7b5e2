"""MinHash near-dedup by an inverted join over signature coordinates.

1. Each text becomes the set of its 5-word shingles (64-bit hashes) and a signature of 32 minima. Rows with equal
   sets are one class, represented by its least doc_id.
2. Representatives are posted under every (coordinate, value). A pair at the similarity sought agrees in at least
   18 of 32 coordinates but for a chance of 2e-5. Counting collisions with prefix and skip merging: with
   coordinates ordered by rarity, any such pair meets in the first 32 - 18 + 1 of both, so only these are joined;
   values that one document holds are skipped, and the long lists at the end are never opened, only compared.
3. Each posting list is merged into the cluster of its pivot, the member whose coordinates are most common; a pair
   meeting in several lists of a pivot is looked at once. Large clusters are cut into blocks, and pairs of blocks
   go to different tasks. Within a block pair, collisions are counted from the posting lists: a member's short lists
   are merged, which gives its candidates, and the long ones are skipped and only looked up for these. Candidates
   above the threshold are confirmed on full sets, and pairs already connected by confirmed links are passed over. So
   every pair of the class graph is either confirmed, refuted or redundant, and the links that come out are no more
   than the rows that went in.
4. Connected components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, components, cut, runtime_filter, table, text_key

WORDS = 5
COORDINATES = 32
COLLISIONS = 18
PERCENT = 85
#: Rows of a block of a cluster, at least and at most, and shingles of a block, at most on average.
BLOCK_ROWS = (128, 2048)
BLOCK_SHINGLES = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; of its whole word sequence if it has fewer words; or none."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, text.encode().lower().split()), dtype=np.uint64)
    if len(w) == 0:
        return w
    n = min(len(w), words)
    h = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        h = h * _ODD + w[i : len(w) - n + 1 + i]
    return np.unique(h ^ (h >> np.uint64(31)))


def coordinate_hashes(coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, coordinates, dtype=np.uint64)


def signature(values: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Minima of the values under each of the hash functions."""
    least = np.full(len(factor), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 4096):
        x = values[None, at : at + 4096] * factor[:, None] + offset[:, None]
        x ^= x >> np.uint64(32)
        x *= _ODD
        np.minimum(least, x.min(axis=1), out=least)
    return least


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, set_hash (null for an empty set), sig array<long> of every row with an id."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor, offset = coordinate_hashes()
        for part in parts:
            out = []
            for doc_id, key, text in zip(part["doc_id"], part["key"], part["text"], strict=True):
                values = shingles(text)
                if len(values):
                    out.append((doc_id, key, len(values), xxhash.xxh3_128_digest(values.tobytes()), signature(values, factor, offset).view(np.int64)))
                else:
                    out.append((doc_id, key, 0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "key", "n_shingles", "set_hash", "sig"])

    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInPandas(
        rows, "doc_id long, key long, n_shingles long, set_hash binary, sig array<long>"
    )


def clusters(classes: DataFrame, collisions: int = COLLISIONS) -> DataFrame:
    """(pivot, rep): every two representatives that agree in enough coordinates share a pivot."""
    prefix = COORDINATES - collisions + 1
    posts = cut(classes.select("rep", F.posexplode("sig").alias("k", "v")).select("rep", F.xxhash64("k", "v").alias("post")))
    sized = attach(posts, ["post"], "rep", {"n": (F.sum, F.lit(1))}).where("n > 1")
    ordered = sized.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "post"))).alias("posts"))
    # Coordinates that no other document holds come first in rarity, and are used up without being joined.
    take = F.size("posts") - (COORDINATES - prefix)
    central = F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    opened = ordered.where(take > 0).select("rep", central.alias("central"), F.explode(F.slice("posts", F.lit(1), take)).alias("p"))
    opened = cut(opened.select("rep", "central", F.col("p.post").alias("post")))
    pivots = attach(opened, ["post"], "rep", {"best": (F.max, F.struct("central", (-F.col("rep")).alias("rep"))), "n": (F.sum, F.lit(1))})
    return pivots.where("n > 1").select((-F.col("best.rep")).alias("pivot"), "rep").distinct()


def class_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, set (its shingle hashes) and sig of the given representatives, from their texts."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor, offset = coordinate_hashes()
        for part in parts:
            out = []
            for rep, text in zip(part["rep"], part["text"], strict=True):
                values = shingles(text)
                out.append((rep, values.tobytes(), signature(values, factor, offset).tobytes()))
            yield pd.DataFrame(out, columns=["rep", "set", "sig"])

    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.where(runtime_filter(reps, "rep")(F.col("rep")))
    d = d.withColumn("key", text_key(F.col("text"))).join(reps.select("rep", "key").distinct(), ["rep", "key"])
    return d.dropDuplicates(["rep", "key"]).select("rep", "text").mapInPandas(rows, "rep long, set binary, sig binary")


def confirmed(part: pd.DataFrame, percent: int, collisions: int) -> pd.DataFrame:
    """Confirmed links between two blocks of a cluster (or within one), leaving out those that connect nothing new."""
    part = part.sort_values(["block", "rep"])
    reps, blocks = part["rep"].to_numpy(), part["block"].to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in part["set"]]
    sig = np.stack([np.frombuffer(x, dtype=np.uint64) for x in part["sig"]])
    size = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(ids.max() + 1, dtype=np.int32)
    root = np.arange(len(reps))
    within = blocks[0] == blocks[-1]
    first_of_other = 0 if within else int(np.searchsorted(blocks, blocks[-1]))
    # The posting lists of the pair of blocks: values are numbered, and the members of each value stand together.
    values = np.stack([np.unique(column, return_inverse=True)[1] for column in sig.T], axis=1)
    members = np.argsort(values, axis=0, kind="stable")
    bounds = [np.searchsorted(values[order, k], np.arange(values[:, k].max() + 2)) for k, order in enumerate(members.T)]
    sizes = np.stack([np.diff(at)[values[:, k]] for k, at in enumerate(bounds)], axis=1)
    coordinates = sig.shape[1]
    by_size = np.argsort(sizes, axis=1, kind="stable")
    links = []
    for a in range(len(reps) if within else first_of_other):
        lo = a + 1 if within else first_of_other
        short, long = by_size[a, : coordinates - collisions + 1], by_size[a, coordinates - collisions + 1 :]
        lists = [members[bounds[k][values[a, k]] : bounds[k][values[a, k] + 1], k] for k in short]
        count = np.bincount(np.concatenate(lists), minlength=len(reps))
        near = lo + np.flatnonzero((count[lo:] > 0) & (root[lo:] != root[a]))
        near = near[count[near] + (values[near][:, long] == values[a, long]).sum(axis=1) >= collisions]
        if len(near) == 0:
            continue
        own = ids[starts[a] : starts[a] + size[a]]
        mark[own] = 1
        if len(near) > 16:
            shared = np.add.reduceat(mark[ids], starts)[near]
        else:
            shared = np.array([mark[ids[starts[b] : starts[b] + size[b]]].sum() for b in near])
        mark[own] = 0
        for b in near[100 * shared >= percent * (size[a] + size[near] - shared)]:
            if root[a] != root[b]:
                links.append((reps[a], reps[b]))
                root[root == root[b]] = root[a]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, collisions: int = COLLISIONS) -> DataFrame:
    """(a, b): confirmed links between representatives, enough to connect all that are connected."""
    members = cut(clusters(classes, collisions).join(classes.select("rep", "n_shingles"), "rep"))
    low, high = BLOCK_ROWS
    rows = F.greatest(F.lit(low), F.least(F.lit(high), F.col("n") / 64))
    n_blocks = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("all") / F.lit(BLOCK_SHINGLES))).cast("long")
    sized = attach(members, ["pivot"], "rep", {"n": (F.sum, F.lit(1)), "all": (F.sum, F.col("n_shingles"))}).where("n > 1")
    dealt = sized.select("pivot", "rep", n_blocks.alias("n_blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    dealt = dealt.select("pivot", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sets = class_sets(docs, cut(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "key")))
    return dealt.join(sets, "rep").groupBy("pivot", "i", "j").applyInPandas(lambda part: confirmed(part, percent, collisions), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, collisions: int = COLLISIONS, keep_columns: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, after ``keep_columns`` of docs.

    docs: doc_id, text; other columns are ignored unless kept. Words are runs of characters other than ASCII white
    space, with A-Z in lower case. Documents are linked where the intersection of their sets is at least
    ``percent`` hundredths of the union. A document without words, null text included, has an empty set and is
    linked with nothing. component_id is the least doc_id reachable; kept says that it is the document's own.
    Rows that repeat a doc_id are one document: with equal texts both are kept or neither, with different texts
    the links of each count for both. A row without a doc_id is linked with nothing, has a null component and is
    kept. An empty docs gives no rows.
    """
    sketches = cut(sketch(docs))
    full = sketches.where("set_hash is not null")
    best = F.min(F.struct("doc_id", "key"))
    classes = full.groupBy("set_hash").agg(best.alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = cut(classes.select("set_hash", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("key"), "n_shingles", "sig"))
    found = components(links(docs, classes, percent, collisions), "a", "b")
    named = classes.join(found, classes["rep"] == found["node"], "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    each = sketches.select("doc_id", "key", "n_shingles", "set_hash").join(named, "set_hash", "left")
    result = each.select(
        "doc_id", "key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if not keep_columns:
        none = docs.where("doc_id is null").select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(True))
        return result.drop("key").unionByName(none.toDF("doc_id", "n_shingles", "component_id", "kept"))
    verdict = result.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.max("kept").alias("kept")
    )
    rows = docs.select(*keep_columns).drop("n_shingles", "component_id", "kept")
    same = (F.col("doc_id") == F.col("__id")) & (text_key(F.coalesce("text", F.lit(""))) == F.col("__key"))
    return rows.join(verdict, same, "left").drop("__id", "__key").withColumn("kept", F.coalesce("kept", F.lit(True)))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents at 0.85. Edges: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))

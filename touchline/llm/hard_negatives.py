"""Hard negatives of anchors by a full sort of each anchor's integer scores.

Rows are dealt out to stripes of a bounded number of rows. A stripe is held in memory, and every anchor passes through
it: its integer scores with the stripe's rows are sorted by score and id, each positive's upper limit is found by binary
search, and the first different-label entries from there on are read, down to the lower limit. What an anchor finds in
a stripe is a few rows; the stripes' findings are merged. The first pass finds the positives, the second, which
needs their scores, the negatives. Anchors travel, rows do not: an anchor is copied once for each stripe, as the query
set (one row in ``every``) is compared with all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

#: Most rows of a stripe, fewest, and stripes that a small table is dealt out to.
STRIPE_ROWS = 32_768
LEAST_ROWS = 256
STRIPES = 64
#: Scores worked on at once.
SCORES_AT_ONCE = 1 << 20
SCALE = 256
LONG = (1 << 63) - 1


def stripes_for(n: int) -> int:
    return max(1, -(-n // STRIPE_ROWS), min(STRIPES, n // LEAST_ROWS))


def labelled_rows(vectors: DataFrame, relabel_every: int, classes: int) -> tuple[DataFrame, str]:
    """rid, vec_id, label (changed where the id says so), raw (the components as bytes) of the rows that take part; numpy's name of a component."""
    e, kind = F.col("embedding"), "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(raw=[np.asarray(x, dtype=kind).tobytes() for x in part["embedding"]]).drop(columns="embedding")

    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    good = vectors.where(vec_id.isNotNull() & label.isNotNull() & e.isNotNull() & finite)
    label = F.when(vec_id % relabel_every == 0, (label + 1) % classes).otherwise(label)
    packed = good.select(vec_id.alias("vec_id"), label.alias("label"), "embedding").mapInPandas(rows, "vec_id long, label long, raw binary")
    return packed.withColumn("rid", F.monotonically_increasing_id()), kind


def quantised(raw: list[bytes], kind: str) -> np.ndarray:
    """floor(256 x) of vectors of one length; a value beyond the doubles is the largest one."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * x))


def scores(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; those beyond a long are cut to its range."""
    if a.size == 0 or r.size == 0:
        return np.zeros((len(a), len(r)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(r).max()) * a.shape[1] < 2.0**53:
        return (a @ r.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(r).T, -LONG - 1, LONG).astype(np.int64)


class Stripe:
    """Rows of one vector length, in order of id, and what an anchor's sorted scores with them say."""

    def __init__(self, rows: pd.DataFrame, kind: str) -> None:
        rows = rows.drop_duplicates(["vec_id", "label", "raw"]).sort_values(["vec_id", "key"], kind="stable")
        self.ids, self.labels, self.keys = (rows[c].to_numpy() for c in ("vec_id", "label", "key"))
        self.q = quantised(list(rows["raw"]), kind)

    def sorted_scores(self, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor its place, the rows in order of falling score, then rising id, and their negated scores."""
        step = max(1, SCORES_AT_ONCE // max(1, len(self.ids)))
        for at in range(0, len(anchors), step):
            negated = -np.maximum(scores(anchors[at : at + step], self.q), -LONG)
            order = np.argsort(negated, axis=1, kind="stable")
            for k in range(len(negated)):
                yield at + k, order[k], negated[k][order[k]]


def first_positives(stripe: Stripe, anchor: tuple, order: np.ndarray, negated: np.ndarray, n: int) -> list[tuple]:
    """(score, id, key) of the first n rows of the anchor's label that have another id."""
    same = np.flatnonzero((stripe.labels[order] == anchor.label) & (stripe.ids[order] != anchor.vec_id))[:n]
    return [(-int(negated[i]), int(stripe.ids[order[i]]), int(stripe.keys[order[i]]), None) for i in same]


def first_negatives(stripe: Stripe, anchor: tuple, order: np.ndarray, negated: np.ndarray, n: int, low: int) -> list[tuple]:
    """(score, id, key, positive's place) of the first n rows of another label at or under each positive's score, as far
    as they have at least ``low`` hundredths of it."""
    other = np.flatnonzero((stripe.labels[order] != anchor.label) & (stripe.ids[order] != anchor.vec_id))
    negated, order, found = negated[other], order[other], []
    for place, limit in enumerate(anchor.limits.tolist()):
        start = int(np.searchsorted(negated, -limit))
        least = -(-low * limit // 100)
        for i in range(start, min(start + n, len(negated))):
            if -int(negated[i]) < least:
                break
            found.append((-int(negated[i]), int(stripe.ids[order[i]]), int(stripe.keys[order[i]]), place))
    return found


def passed(rows: DataFrame, anchors: DataFrame, kind: str, stripes: int, read: Callable) -> DataFrame:
    """rid, score, id, key, place: what ``read`` finds for each anchor in each stripe. anchors: the columns of rows, and limits."""
    columns = ["stripe", "rid", "vec_id", "label", "key", "raw"]
    mine = rows.withColumns({"stripe": F.pmod(F.xxhash64("rid"), F.lit(stripes)).cast("int"), "limits": F.lit(None).cast("array<long>")})
    every = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    both = mine.select(*columns, "limits", F.lit(0).alias("kind")).unionByName(every.select(*columns, "limits", F.lit(1).alias("kind")))

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, built = None, [], {}
        for part in parts:
            for (number, role), group in part.groupby(["stripe", "kind"], sort=True):
                if number != at:
                    at, held, built = number, [], {}
                if role == 0:
                    held.append(group)
                    continue
                if held:
                    whole = pd.concat(held)
                    built = {n: Stripe(rows, kind) for n, rows in whole.groupby(whole["raw"].str.len())}
                    held = []
                for length, same in group.groupby(group["raw"].str.len()):
                    if (stripe := built.get(length)) is None:
                        continue
                    known, found = list(same.itertuples(index=False)), []
                    for k, order, negated in stripe.sorted_scores(quantised(list(same["raw"]), kind)):
                        found += [(known[k].rid, *x) for x in read(stripe, known[k], order, negated)]
                    out = pd.DataFrame(found, columns=["rid", "score", "id", "key", "place"])
                    yield out.astype({"place": "Int32"})

    placed = both.repartition(stripes, "stripe").sortWithinPartitions("stripe", "kind")
    return placed.mapInPandas(stream, "rid long, score long, id long, key long, place int")


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, relabel_every: int = 7, classes: int = 10
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding (array of float or double), label; other columns are ignored. Anchors: rows whose id is
    divisible by ``every``. Rows with a null id, label or vector, or a null or non-finite component, take no part. A
    row of another length than the anchor is not compared with it; vectors without components have a score of 0. Rows
    that repeat a row count once; rows that share an id but differ are rows of their own, of which none is a positive or
    negative of another. An anchor without positives, and a positive without negatives in its limits, gives no
    rows. An empty vectors gives no rows. Scores beyond a long are cut to its range.
    """
    rows, kind = labelled_rows(vectors, relabel_every, classes)
    rows = cut(rows.withColumn("key", F.xxhash64("label", "raw")))
    n = stripes_for(rows.count())
    once = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "key", "raw").agg(F.min("rid").alias("rid"))
    none = F.lit(None).cast("array<long>")
    found = passed(rows, once.withColumn("limits", none), kind, n, lambda s, a, order, negated: first_positives(s, a, order, negated, positives))
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "id", "key")
    found = found.drop("place").distinct().withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives)
    found = cut(found.withColumnsRenamed({"score": "positive_score", "id": "positive_id"}).drop("key"))
    limits = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # ``positives`` entries at most
    anchors = once.join(limits.select("rid", F.col("p.positive_score").alias("limits")), "rid")
    hard = passed(rows, anchors, kind, n, lambda s, a, order, negated: first_negatives(s, a, order, negated, negatives, low))
    best = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "id", "key")
    hard = hard.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    told = hard.join(found, ["rid", "place"]).join(once.select("rid", "vec_id"), "rid")
    return told.select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding. Edges: see ``mine``."""
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5
"""

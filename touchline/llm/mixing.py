"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source of n documents and target share w of a mixture of T documents has the mean repetition rate T * w / n. A
document's count is the Poisson quantile, at that mean, of a uniform number hashed from its id and a seed: the same rows give the same mixture in any order and on any cluster. Each document is exploded by its count,
and the copies are dealt out over partitions and sorted within them by a second hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

SEED = 20
#: Most sources whose rates are broadcast (a few MB); beyond it both sides of the join are salted and shuffled.
BROADCAST_SOURCES = 50_000
SALTS = 64
TEMPERATURE = 0.5


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest, which other engines can compute too."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_quantile(mean: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u, for X Poisson of that mean.

    Terms are kept as logarithms, so a large mean does not underflow; the sum ends 12 deviations and 30 above the
    mean, beyond what 52 bits of u can reach.
    """
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    zero = F.struct(F.lit(0).alias("k"), (-mean).alias("log_p"), F.exp(-mean).alias("cdf"))

    def step(s: Column, j: Column) -> Column:
        log_p = s["log_p"] + F.log(mean) - F.log(j.cast("double"))
        return F.when(s["cdf"] > u, s).otherwise(F.struct(j.alias("k"), log_p.alias("log_p"), (s["cdf"] + F.exp(log_p)).alias("cdf")))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda s: s["k"])).otherwise(0)


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None, size: int | None, temperature: float) -> tuple[DataFrame, int]:
    """(of, rate) for every source of docs, one row a source; and how many sources there are."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, w double")
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = weighted.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    goal = float((total["n"] or 0) if size is None else size)
    rate = F.coalesce(F.try_divide(F.lit(goal) * F.col("w"), F.lit(float(total["w"] or 0)) * F.col("n")), F.lit(0.0))
    return weighted.select(F.col("source").alias("of"), rate.alias("rate")), total["sources"]


def with_rates(docs: DataFrame, rates: DataFrame, sources: int, most: int = BROADCAST_SOURCES, *, into: str = "rate") -> DataFrame:
    """docs with the rate of their source in a column named ``into``."""
    of, salt, other = unused([*docs.columns, into], "of", "salt", "salt2")
    rates = rates.select(F.col("of").alias(of), F.col("rate").alias(into))
    same = F.col("source").eqNullSafe(F.col(of))
    if sources <= most:
        return docs.join(F.broadcast(rates), same).drop(of)
    salted = rates.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
    return docs.join(salted, same & (F.col(salt) == F.col(other))).drop(of, salt, other)


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, size: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED
) -> DataFrame:
    """Copies of the rows of docs, with n_copies, copy (from 0) and shuffle_key added, in a global shuffle.

    docs: doc_id, text, source; other columns are kept, those named as a result are replaced. weights: target
    share by source, scaled to sum to 1; a source without one is left out. None: shares in proportion to the
    number of documents to the power ``temperature``. size: expected number of rows, by default as many as docs
    has. A null source is a source of its own; null ids and texts hash as empty, so they are mixed like others.
    Rows that repeat an id get the same count, each. An empty docs gives no rows.
    """
    rates, sources = repetition_rates(docs, weights, size, temperature)
    docs = docs.drop("n_copies", "copy", "shuffle_key")
    own = [F.col("doc_id"), F.xxhash64("text").cast("string")]
    (rate,) = unused([*docs.columns, "n_copies", "copy", "shuffle_key"], "rate")
    row = with_rates(docs, rates, sources, into=rate)
    row = row.withColumn("n_copies", poisson_quantile(F.col(rate), uniform(seed, F.col("doc_id"))).cast("long")).drop(rate)
    row = row.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    row = row.withColumn("shuffle_key", F.xxhash64(F.lit(seed), *own, F.col("copy")))
    return row.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy with its place in the shuffle left out: the hash differs between engines, the copies do not."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("shuffle_key")


OP2_SQL = f"""
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s) * w / ((SELECT sum(w) FROM s) * n) AS rate FROM s),
p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(0, 200)) AS k)),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM documents),
c AS (SELECT u.doc_id, count(*) AS n_copies FROM u JOIN p ON p.source = u.source AND p.cdf <= u.u GROUP BY u.doc_id)
SELECT d.doc_id, text, lang, source, n_chars, n_copies, unnest(range(0, n_copies)) AS copy FROM documents d JOIN c ON c.doc_id = d.doc_id
"""

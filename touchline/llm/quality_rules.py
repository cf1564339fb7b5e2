"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio, in DataFrame expressions only.

Two multinomials over hashed word unigrams and bigrams are counted: one from trusted documents, one from the
whole corpus. A document's score is the mean log ratio of its n-grams; every document at or above a fixed
threshold passes. The ratio table has ``buckets`` entries whatever the corpus, so it goes into the plan as a
constant array, and scoring needs no exchange at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runtime_filter, table, unused

BUCKETS = 1 << 15
SMOOTHING = 8.0
THRESHOLD = -0.1
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]


def split_words(text: Column) -> Column:
    """The words of a text, in order; an empty array if it has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(h: Column) -> Column:
    """How many words lie in a 5-word window that the text holds twice or more; h: the words' hashes."""

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - p, F.lit(5))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def spans(order: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(order, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(order, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), total)

    def covered(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(order, spans))

    windows = F.transform(
        F.slice(h, 1, F.size(h) - 4), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4))
    )
    return F.when(F.size(h) < 5, F.lit(0).cast("long")).otherwise(let(windows, covered))


def word_hashes(text: Column) -> Column:
    return let(split_words(text), lambda w: F.transform(w, lambda x: F.xxhash64(x)))


def gram_buckets(h: Column, buckets: int) -> Column:
    """Hash buckets of the unigrams, then of the bigrams, of a text's word hashes."""
    unigrams = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    heads = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
    return F.concat(unigrams, F.transform(heads, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(buckets)).cast("int")))


def base_columns(text: Column, w: Column, h: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)),
        "n_symbols": (F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(h),
    }


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of the trusted over the raw multinomial, by bucket.

    The trusted one is smoothed by ``smoothing`` * ``buckets`` further counts spread as in the raw one, so that a
    target like the corpus has ratios of 0 at every size.
    The counts are summed on the cluster; what the driver reads has ``buckets`` rows at most. Without a trusted
    document all ratios are 0.
    """

    # Texts whose id may be trusted are merged with the trusted ids, not broadcast: the labels can grow with the corpus, and
    # so the plan is the same at every size. All other texts are counted where they are read.
    good = trusted.select("doc_id").distinct()
    likely = F.coalesce(runtime_filter(good, "doc_id")(F.col("doc_id").cast(good.schema["doc_id"].dataType)), F.lit(False))
    texts = docs.select("doc_id", "text")
    marked = texts.where(likely).join(good.withColumn("good", F.lit(1)).hint("merge"), "doc_id", "left")
    raw, target = [0] * buckets, [0] * buckets
    for rows in (marked, texts.where(~likely).withColumn("good", F.lit(None).cast("int"))):
        grams = rows.select("good", word_hashes(F.col("text")).alias("h"))
        grams = grams.select("good", F.explode(gram_buckets(F.col("h"), buckets)).alias("bucket"))
        for row in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect():
            raw[row["bucket"]] += row["raw"]
            target[row["bucket"]] += row["target"]
    if not sum(target):
        return [0.0] * buckets
    wide, narrow, prior = sum(raw), sum(target), smoothing * buckets
    return [math.log((t * wide / r + prior) / (narrow + prior)) if r else 0.0 for t, r in zip(target, raw, strict=True)]


def score_documents(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """Every row of docs with its base statistics, score and verdict.

    docs: doc_id, text and any other columns, which are kept; those named as a result are replaced. trusted: the
    doc_id of the target rows. A null or empty text has no words: score 0, base_failed, not kept. Repeated rows,
    rows that repeat a doc_id and rows without one each get their own verdict. With no trusted document the
    ratios are 0 and the base rules alone decide. An empty docs gives no rows.
    """
    ratios = log_ratios(docs, trusted, buckets, smoothing)
    by_bucket = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def mean(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(by_bucket, b))
        return F.coalesce(F.round(F.try_divide(total, F.size(g)), 9), F.lit(0.0))

    def judged(x: Column) -> Column:
        failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
        kept = ~failed & (x["score"] >= threshold)
        return F.struct(*[x[c].alias(c) for c in RESULTS[:6]], failed.alias("base_failed"), kept.alias("kept"))

    def measured(w: Column, h: Column) -> Column:
        found = base_columns(text, w, h) | {"score": let(gram_buckets(h, buckets), mean)}
        return let(F.struct(*[found[c].alias(c) for c in RESULTS[:6]]), judged)

    # One expression in which every part is bound once: a filter on a result may be pushed down at no great cost.
    text = F.coalesce("text", F.lit(""))
    verdict = let(split_words(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: measured(w, h)))
    (v,) = unused(docs.columns, "verdict")
    row = docs.withColumn(v, verdict)
    return row.select(*[c for c in docs.columns if c.lower() not in RESULTS], f"{v}.*")


def trusted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted target: rows labelled as good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document. Edges: see ``score_documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, trusted_rows(spark, sf_dir)).select("doc_id", *RESULTS)

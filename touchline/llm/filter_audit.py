"""Audit of how five document filters interact: what each removes in each order, alone or after the others.

Texts are scanned where they lie in Arrow's buffers: a table of byte classes and prefix sums give the words, capitals,
symbols and code points of many documents at once. Words are hashed by differences of one prefix sum; within a
document the sorted hashes, whose equal neighbours are compared byte by byte, give the distinct words. What is left of a
document is a mask of the filters that it fails, with a digest of its text for the search of copies. Masks are
counted by part, and every order of the filters is worked out from these counts: 32 a part, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, table

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
#: Bytes of text that are scanned at once; a longer text is scanned in pieces.
CHUNK = 1 << 20
#: Longest word that is compared eight bytes at a time.
LONG_WORD = 64

SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
CLASSES = np.zeros(256, dtype=np.uint8)
CLASSES[[*b" \t\n\x0b\x0c\r"]] = SPACE
CLASSES[65:91] = CAPITAL
CLASSES[[*SYMBOLS]] = SYMBOL
CLASSES[0x80:0xC0] = INNER  # all but the first byte of a code point
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(base: int) -> np.ndarray:
    """base ** 0 .. base ** CHUNK, modulo 2 ** 64."""
    out = np.full(CHUNK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Counts of documents that lie one after another in a buffer."""

    def __init__(self) -> None:
        self.up, self.down = powers(FACTOR), powers(INVERSE)

    def scan(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """words, distinct words, capitals, symbols, code points of the documents data[at[k]:at[k + 1]]; no more than CHUNK bytes."""
        kind = CLASSES[data]
        inside = kind != SPACE
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = at[:-1][at[:-1] < len(data)]
        first[edge] = inside[edge]
        edge = at[1:][at[1:] > 0] - 1
        last[edge] = inside[edge]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        upto = np.searchsorted(starts, at)
        words = np.diff(upto)

        def total(flag: int) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(kind == flag, dtype=np.int64)))
            return sums[at[1:]] - sums[at[:-1]]

        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)))
        hashes = (sums[ends] - sums[starts]) * self.down[starts]
        distinct = self.distinct(data, starts, ends, hashes, np.repeat(np.arange(len(words)), words), words)
        return words, distinct, total(CAPITAL), total(SYMBOL), np.diff(at) - total(INNER)

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Distinct words by document: words less the neighbours, in order of hash, that are the same word."""
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        pair = np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1]))
        a, b = order[pair], order[pair + 1]
        length = ends[a] - starts[a]
        equal = length == ends[b] - starts[b]
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        for k in range(0, LONG_WORD, 8):
            live = np.flatnonzero(equal & (length > k) & (length <= LONG_WORD))
            if not len(live):
                break
            rest = np.minimum(length[live] - k, 8).astype(np.uint64)
            unread = (np.uint64(8) - rest) * np.uint64(8)  # bits of the eight bytes that belong to what follows
            x, y = eight[starts[a[live]] + k], eight[starts[b[live]] + k]
            equal[live] = ((x ^ y) << unread) == 0
        for k in np.flatnonzero(equal & (length > LONG_WORD)):
            equal[k] = bool((data[starts[a[k]] : ends[a[k]]] == data[starts[b[k]] : ends[b[k]]]).all())
        found = words - np.bincount(o[pair], minlength=len(words))
        for k in np.unique(o[pair[~equal]]):  # two words of one hash: counted as they are
            own = owner == k
            found[k] = len({data[s:e].tobytes() for s, e in zip(starts[own], ends[own], strict=True)})
        return found

    def scan_long(self, data: np.ndarray) -> tuple[int, ...]:
        """The counts of one document of any length. A word longer than CHUNK is taken as it is, in one piece."""
        counts, seen, at = np.zeros(4, dtype=np.int64), set(), 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            if end < len(data):
                gaps = np.flatnonzero(CLASSES[data[at:end]] == SPACE)
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    while end < len(data) and CLASSES[data[end]] != SPACE:
                        end += 1
            kind, own = CLASSES[data[at:end]], data[at:end].tobytes().split()
            seen.update(hashlib.blake2b(w, digest_size=16).digest() if len(w) > LONG_WORD else w for w in own)
            counts += (len(own), (kind == CAPITAL).sum(), (kind == SYMBOL).sum(), (kind != INNER).sum())
            at = end
        return int(counts[0]), len(seen), *map(int, counts[1:])


def masks_of(words: np.ndarray, distinct: np.ndarray, capitals: np.ndarray, symbols: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Bits of the first four filters that a document fails."""
    failed = (words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def scanned(batch: pa.RecordBatch, scanner: Scanner) -> pa.RecordBatch:
    """doc_id, part, mask, digest of a batch of doc_id, text, lang."""
    text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    if text.offset:
        text = pa.concat_arrays([text])
    _, offsets, content = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[: len(text) + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    mask, lo = np.zeros(len(text), dtype=np.int32), 0
    while lo < len(text):
        if at[lo + 1] - at[lo] > CHUNK:
            mask[lo] = masks_of(*np.array([scanner.scan_long(data[at[lo] : at[lo + 1]])]).T)[0]
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
        mask[lo:hi] = masks_of(*scanner.scan(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
        lo = hi
    view = memoryview(data)
    digest = [hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in itertools.pairwise(at.tolist())]
    part = pc.fill_null(batch.column("lang").cast(pa.string()), "")
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), part, pa.array(mask), pa.array(digest, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of docs (doc_id, text, lang): a bit for each filter that it fails."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            yield scanned(batch, scanner)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    found = slim.mapInArrow(rows, "doc_id long, part string, mask int, digest binary")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    marked = attach(found, ["digest"], "row", {"least": (F.min, F.col("doc_id"))})
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return marked.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def steps() -> Column:
    """An array with an entry for every order of the filters and step: order, step, bit (of the step's filter), before (bits of those before it)."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            rows.append({"order": "".join(order), "step": k + 1, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are ignored. The parts are the values of lang,
    null and the empty text being one. A null text is an empty one: it fails A, and E if an empty text has a smaller id. Rows
    that repeat an id count each, and are no copies of one another; a row without an id is a copy of nothing, nothing is
    a copy of it, and it has no label. A document is good, or toxic, if any of its labels says so. Without documents there are no rows.
    """
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    counted = document_masks(docs).join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")
    )
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("masks"))  # 32 entries at most
    rows = rows.withColumn("s", F.explode(steps()))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(which: Column | None, count: str = "n", holds=None) -> Column:
        value = lambda m: F.when(holds(m["mask"]), m[count] if which is None else m[count] * which(m["mask"])).otherwise(0)
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + value(m))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    share = lambda m: F.lit(120).cast("long") / F.bit_count(m)  # noqa: E731  of 120 orders, in those a filter comes first of the ones failed
    return rows.select(
        "part", F.col("s.order").alias("filter_order"), F.col("s.step").alias("step"),
        total(None, holds=lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(None, holds=here).alias("removed"),
        total(None, holds=lambda m: fails(m) & gone(m)).alias("redundant"),
        total(None, holds=lambda m: m == bit).alias("unique_fails"),
        total(None, "good", here).alias("good_lost"),
        total(None, "bad", here).alias("toxic_lost"),
        total(lambda m: share(m).cast("long"), holds=fails).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all documents. Edges: see ``audit``."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM x p JOIN x q ON q.x <> p.x JOIN x r ON r.x NOT IN (p.x, q.x) JOIN x s ON s.x NOT IN (p.x, q.x, r.x) JOIN x t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
k AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
z AS (SELECT filter_order, step, bit, CAST(coalesce(before, 0) AS INT) AS before FROM k)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM m, z GROUP BY part, filter_order, step
"""

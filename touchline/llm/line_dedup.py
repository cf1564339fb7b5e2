"""Line dedup by winnowing: later repeats of runs of lines are deleted.

Lines are hashed; blank lines are passed over. At each line starts a gram, the fewest lines that hold ``noise_words``
words. Two passes find the repeats:

* **Windows**: each window of ``WINDOW_LINES`` grams in a row selects its least gram hash as fingerprint, about two
  grams in seven. A repeated run that is longer than a window always holds a fingerprint that is selected in both copies. A
  fingerprint travels with the hash of all lines up to the one before it, and of all up to the next; where such a stretch
  is equal in both copies, the match is extended over it, and so from fingerprint to fingerprint over the whole run.
* **Single grams**: runs that no window guarantees, down to one line, are found by the grams themselves, extended line
  by line over the short lines next to them.

In both, a fingerprint is joined to its earliest position in the corpus (least doc_id, then line), one match for
each position: a passage that a third of the corpus shares gives as many rows as it has copies, dealt out over many tasks.
What is equal to lines at an earlier position is deleted, and reported as a run with its source. No task reads a whole
document for another's sake.

With grams of three words, every line of three words or more that stands earlier in the corpus is deleted, alone or in a
run; of shorter lines, a repeated rest of fewer than three words can stay. Every deleted line has an equal line at an
earlier position that stands in the output or was equal to one that does.

Where the caller asks for a guarantee of more words than a gram has, there is one pass, over windows of so many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, table, text_key, unused

#: A line of as many words is a gram of its own; lines of fewer are joined to the next.
NOISE_WORDS = 3
GUARANTEE_WORDS = 3
#: Grams of a window of the first pass.
WINDOW_LINES = 6
#: Fingerprints that a task hands on at once.
ROWS_AT_ONCE = 2_000


def fingerprints(hashes: np.ndarray, n_words: np.ndarray, noise: int, guarantee: int) -> tuple[list[int], list[int]]:
    """Positions and gram hashes that the windows of one document select."""
    n, upto = len(hashes), np.concatenate(([0], np.cumsum(n_words)))
    ends = np.searchsorted(upto, upto[:-1] + noise)  # a gram at i has the lines i .. ends[i] - 1
    grams: list[int] = []
    for i, end in enumerate(ends.tolist()):
        if end > n:
            break
        grams.append(xxhash.xxh64_intdigest(hashes[i:end].tobytes()))
    last = np.searchsorted(ends, np.searchsorted(upto, upto[:-1] + guarantee), side="right") - 1
    chosen: set[int] = set()
    for i in range(len(grams)):
        if upto[-1] - upto[i] < guarantee:
            break
        chosen.add(min(range(i, int(last[i]) + 1), key=grams.__getitem__))
    at = sorted(chosen)
    return at, [grams[i] for i in at]


def minima(grams: np.ndarray, width: int = WINDOW_LINES) -> np.ndarray:
    """Positions of the least gram of every window of ``width`` grams, or of all if there are fewer."""
    if len(grams) <= width:
        return np.array([grams.argmin()] if len(grams) else [], dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def hash_of(hashes: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(hashes.tobytes())
    return h - (h >> 63 << 64)


def sketch_lines(docs: DataFrame, noise_words: int, guarantee_words: int) -> DataFrame:
    """A row for each selected fingerprint: doc_id, key, windows (whether of the first pass), gram, line (its first line's
    number in the text), and the numbers of its other lines (own), and of those around it: before, from the nearest on, and after, with
    their hashes, one a line; in the first pass one for the stretch up to the next fingerprint. Empty arrays are null."""
    names = ["doc_id", "key", "windows", "gram", "line", "own", "before", "before_hash", "after", "after_hash"]
    two = guarantee_words <= noise_words

    def sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, key, text in zip(part["doc_id"], part["key"], part["text"], strict=True):
                lines = [(i, line.strip(), len(line.split())) for i, line in enumerate(text.encode().split(b"\n"))]
                lines = [x for x in lines if x[2]]
                number = [x[0] for x in lines]
                hashes = np.array([xxhash.xxh64_intdigest(x[1]) for x in lines], dtype=np.uint64)
                n_words = np.array([x[2] for x in lines], dtype=np.int64)
                at, grams = fingerprints(hashes, n_words, noise_words, guarantee_words)
                signed, upto = hashes.view(np.int64).tolist(), np.concatenate(([0], np.cumsum(n_words)))
                ends = np.searchsorted(upto, upto[at] + noise_words)
                los = np.searchsorted(upto, upto[at] - guarantee_words, side="right").tolist()
                his = (np.searchsorted(upto, upto[ends] + guarantee_words, side="left") - 1).tolist()
                for i, gram, end, lo, hi in zip(at, grams, ends.tolist(), los, his, strict=True):
                    rows.append((doc_id, key, False, gram - (gram >> 63 << 64), number[i], number[i + 1 : end] or None,
                                 number[lo:i][::-1] or None, signed[lo:i][::-1] or None, number[end:hi] or None, signed[end:hi] or None))
                if two and len(at) > 1:  # every gram is in ``at``, in order
                    chosen = minima(np.array(grams, dtype=np.uint64)).tolist()
                    first = [at[k] for k in chosen]
                    for k, lo, hi in zip(chosen, [-1, *first[:-1]], [*first[1:], len(lines)], strict=True):
                        i, end, gram = at[k], int(ends[k]), grams[k]
                        rows.append((doc_id, key, True, gram - (gram >> 63 << 64), number[i], number[i + 1 : end] or None,
                                     number[lo + 1 : i] or None, [hash_of(hashes[lo + 1 : i])], number[end:hi] or None, [hash_of(hashes[i + 1 : hi])]))
                if len(rows) > ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, key long, windows boolean, gram long, line int, own array<int>, before array<int>, before_hash array<long>, after array<int>, after_hash array<long>"
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInPandas(sketch, schema)


def agreeing(mine: str, other: str, numbers: str) -> Column:
    """The first of ``numbers``, as many as the hashes in both arrays agree from the start on; in the first pass, all or none."""
    equal = F.zip_with(F.slice(mine, F.lit(1), F.least(F.size(mine), F.size(other))), F.slice(other, F.lit(1), F.least(F.size(mine), F.size(other))), lambda a, b: a == b)
    line_by_line = F.slice(numbers, F.lit(1), F.when(F.forall(equal, lambda x: x), F.size(equal)).otherwise(F.array_position(equal, False).cast("int") - 1))
    whole = F.when(F.col(mine) == F.col(other), F.col(numbers))
    return F.coalesce(F.when(F.col("windows"), whole).otherwise(line_by_line), F.array().cast("array<int>"))


def segments(lines: Column, source: Column, shift: Column) -> Column:
    """Runs of numbers in a row in a sorted array: first and last line, and where the run stands in its source."""
    firsts = F.filter(lines, lambda x, i: (i == 0) | (x - F.coalesce(F.get(lines, i - 1), x) > 1))
    lasts = F.filter(lines, lambda x, i: F.coalesce(F.get(lines, i + 1) - x, F.lit(2)) > 1)
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first_line"), b.alias("last_line"), source.alias("source_id"), (a - shift).alias("source_line")))


def repeated_lines(docs: DataFrame, noise_words: int = NOISE_WORDS, guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """(doc_id, key, gone, runs): numbers of the lines to delete, and the runs that they are in; documents without any are absent.

    A run: first_line, last_line, source_id and source_line, which is exact where blank lines stand alike in both. Blank lines end
    a run, and a line may be in several runs.
    """
    posts = cut(sketch_lines(docs, noise_words, guarantee_words))
    place = F.struct("doc_id", "key", "line")
    first = F.struct("doc_id", "key", "line", "before_hash", "after_hash")  # the first three are unique, but for repeated rows
    matches = attach(posts, ["windows", "gram"], "doc_id", {"first": (F.min, first), "last": (F.max, place)}).where(
        F.struct("first.doc_id", "first.key", "first.line") < F.col("last")
    )
    later = matches.where(F.struct("first.doc_id", "first.key", "first.line") < place)
    run = F.concat(F.array("line"), F.coalesce("own", F.array().cast("array<int>")), agreeing("before_hash", "first.before_hash", "before"), agreeing("after_hash", "first.after_hash", "after"))
    found = later.select("doc_id", "key", F.col("first.doc_id").alias("source"), F.col("first.key").alias("other"), (F.col("line") - F.col("first.line")).alias("shift"), run.alias("run"))
    sorted_lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list("run"))))
    alike = found.repartition("doc_id", "key").groupBy("doc_id", "key", "source", "other", "shift").agg(sorted_lines.alias("run"))
    runs = alike.select("doc_id", "key", "run", segments(F.col("run"), F.col("source"), F.col("shift")).alias("runs"))
    return runs.groupBy("doc_id", "key").agg(sorted_lines.alias("gone"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))


def dedup_lines(docs: DataFrame, noise_words: int = NOISE_WORDS, guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted from text, and n_lines, n_removed, emptied, runs added.

    docs: doc_id, text; other columns are kept, those named as a result are replaced. Lines are compared without
    the white space at their ends. The earlier run is the one with the lesser doc_id, then the one further up;
    rows that repeat a doc_id and text count as one document and lose the same lines. A null text, and a row
    without a doc_id, stays as it is. A document that loses every line with a word is ``emptied``, its text
    then being empty. A text without words is not emptied. runs: see ``repeated_lines``; empty if nothing is deleted. An
    empty docs gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed", "emptied", "runs")
    id_, key, gone_, lines_ = unused([*docs.columns, "n_lines", "n_removed", "emptied", "runs"], "id", "key", "gone", "lines")
    gone = repeated_lines(docs, noise_words, guarantee_words).withColumnsRenamed({"doc_id": id_, "key": key, "gone": gone_})
    row = docs.join(gone, (docs["doc_id"] == gone[id_]) & (text_key(docs["text"]) == gone[key]), "left")
    row = row.withColumn(lines_, F.split("text", "\n", -1))
    lines = F.col(lines_)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_)
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines_), i)), "\n")
    hit = F.col(gone_).isNotNull()
    row = row.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "n_removed": F.when(hit, F.size(gone_)).otherwise(0).cast("long"),
            "text": F.when(hit, left).otherwise(F.col("text")),
            "runs": F.coalesce("runs", F.array().cast(gone.schema["runs"].dataType)),
        }
    )
    emptied = hit & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    row = row.withColumn("emptied", F.coalesce(emptied, F.lit(False)))
    return row.withColumn("text", F.when(F.col("emptied"), F.lit("")).otherwise(F.col("text"))).drop(id_, key, gone_, lines_)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines. Edges: see ``dedup_lines``."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))

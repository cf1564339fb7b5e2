"""Packing token sequences: shortest pack first over the length histogram.

Documents are tokenized and cut into pieces of at most ``capacity`` ids: full ones from the front, then the rest.
The histogram of piece lengths, of ``capacity`` bins whatever the corpus, comes to the driver, which places
lengths longest first into the shortest packs they fit in, and only updates counts of packing patterns (after
Krell et al. 2021). The patterns go back as a table of (length, slot) rank ranges, and each piece finds its
sequence by its rank among the pieces of its length. Ranks are counted in two steps, so that no task holds all
pieces of a common length.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps; further words are encoded each time.
CACHED_WORDS = 800_000
#: Pieces of a length are ranked in sub-bins of about so many.
RANK_ROWS = 100
BINS_A_GROUP = 1000
#: Punctuation other than an apostrophe behind a letter: the tokenizer always splits there. The rarer character is looked for first.
_EDGE = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)")
_cache: dict[bytes, bytes] = {}
_loaded: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_text(text: str | None) -> list[bytes]:
    """Parts of a text whose ids, in turn, are the text's ids, cut so that few parts are new to a worker.

    The tokenizer lowers letters, drops white space and splits between letters and punctuation; a text that may
    hold one of its special tokens, which are case-sensitive, is only split at white space.
    """
    data = (text or "").encode()
    return data.split() if b"<|" in data else _EDGE.sub(rb" \g<0>", data.lower()).split()


def encode_words(path: str, texts: list[list[bytes]]) -> list[bytes]:
    """Ids of texts given as parts (see ``split_text``), as little-endian unsigned 32-bit numbers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _loaded:
        _loaded.clear()
        _cache.clear()
        _loaded[path] = Tokenizer.from_file(path)
    found = [list(map(_cache.get, words)) for words in texts]
    missed = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
    new = {words[i] for words, places in zip(texts, missed, strict=True) for i in places}
    if new:
        order = list(new)
        coded = _loaded[path].encode_batch_fast([w.decode() for w in order], add_special_tokens=False)
        fresh = {w: struct.pack(f"<{len(x.ids)}I", *x.ids) for w, x in zip(order, coded, strict=True)}
        for words, ids, places in zip(texts, found, missed, strict=True):
            for i in places:
                ids[i] = fresh[words[i]]
        if len(_cache) < CACHED_WORDS:
            _cache.update(fresh)
    return list(map(b"".join, found))


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents' ids: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens."""
    path = path or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                few = part.iloc[at : at + 256]
                out = []
                texts = [split_text(t) for t in few["text"]]
                for doc_id, ids in zip(few["doc_id"], encode_words(path, texts), strict=True):
                    ids += end
                    total = len(ids) // 4
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc_id, start, len(piece) // 4, piece, total))
                frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens"])
                yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        rows, "doc_id long, start long, length long, ids binary, doc_tokens long"
    )


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns that hold every length as often as the histogram says."""
    packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    heap: list[int] = []

    def put(used: int, pattern: tuple[int, ...], count: int) -> None:
        if not packs[used]:
            heapq.heappush(heap, used)
        packs[used][pattern] += count

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            while heap and not packs[heap[0]]:
                heapq.heappop(heap)
            if heap and heap[0] + length <= capacity:
                used = heap[0]
                pattern, count = packs[used].popitem()
                take = min(todo, count)
                if take < count:
                    packs[used][pattern] = count - take
                put(used + length, (*pattern, length), take)
                todo -= take
            else:
                put(length, (length,), todo)
                todo = 0
    return [(count, pattern) for held in packs.values() for pattern, count in held.items()]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) for every slot of every pattern."""
    out, ranks, sequence = [], defaultdict(int), 0
    for count, pattern in sorted(patterns, key=lambda x: x[1], reverse=True):
        offset = 0
        for length in pattern:
            out.append((length, ranks[length], ranks[length] + count - 1, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """pieces with sequence_id and offset added: each sequence is filled from 0 without gaps, up to ``capacity``.

    pieces: length (1 to capacity), doc_id, start; other columns are kept. Equal pieces each get a place of their
    own. No pieces give no rows.
    """
    pieces = cut(pieces.drop("sequence_id", "offset"))
    columns = pieces.columns
    pieces = pieces.withColumn("__row", F.monotonically_increasing_id())  # the same each time, as the pieces are written
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = pieces.sparkSession
    table_of_slots = spark.createDataFrame(
        slots(pack_histogram(histogram, capacity)), "__length long, first_rank long, last_rank long, first_sequence long, offset long"
    )
    # Rank in three steps, so that no task sees all of a length's pieces or sub-bins: the first rank of a group of
    # sub-bins, that of the sub-bin within it, both from counts, and the row's number within the sub-bin.
    parts = spark.createDataFrame([(k, -(-n // rank_rows)) for k, n in histogram.items()], "length long, __parts long")
    binned = pieces.join(F.broadcast(parts), "length")  # a row a length, ``capacity`` at most
    binned = binned.withColumn("__bin", F.pmod(F.xxhash64("__row"), F.col("__parts"))).drop("__parts")
    counts = binned.groupBy("length", "__bin").agg(F.count("*").alias("n"))
    counts = counts.withColumn("__group", F.floor(F.col("__bin") / BINS_A_GROUP))
    earlier = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("length", "__group").agg(F.sum("n").alias("n"))
    groups = groups.select("length", "__group", earlier(["length"], "__group").alias("__first"))
    counts = counts.select("length", "__bin", "__group", earlier(["length", "__group"], "__bin").alias("__within")).join(groups, ["length", "__group"])
    counts = counts.select("length", "__bin", (F.col("__first") + F.col("__within")).alias("__base"))
    number = F.row_number().over(Window.partitionBy("length", "__bin").orderBy("doc_id", "start", "__row")) - 1
    ranked = binned.withColumn("__number", number).join(counts, ["length", "__bin"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__number"))
    # The slots are bounded by the patterns of ``capacity`` lengths, not by the corpus.
    here = (F.col("length") == F.col("__length")) & F.col("__rank").between(F.col("first_rank"), F.col("last_rank"))
    placed = ranked.join(F.broadcast(table_of_slots), here)
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.col("__rank") - F.col("first_rank"))
    return placed.select(*columns, "sequence_id", "offset")


def packed_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The places of all pieces of docs, with a checksum of each piece's ids in place of the ids.

    docs: doc_id, text; other columns are ignored. A null or empty text is the end id alone. Rows that repeat a
    doc_id are documents of their own. A null doc_id stays null. An empty docs gives no rows.
    """
    pieces = tokenize(docs, path).withColumn("ids_crc32", F.crc32("ids"))
    placed = pack(pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents. Edges: see ``packed_digests``."""
    return packed_digests(table(spark, sf_dir, "documents"))

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from touchline.llm import common, embedding_dedup, near_dedup
from touchline.llm.common import components
from touchline.llm.mixing import mix_sources, op2_mixing
from touchline.llm.packing import encode_words, op7_packing, pack_histogram, packed_digests, tokenizer_path

from .helpers import SF, Sets, documents


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_near(texts, percent=85):
    sets = {d: shingle_set(t) for d, t in texts}
    held, groups = defaultdict(list), Sets(sets)
    for d, s in sets.items():
        shared = Counter(o for x in s for o in held[x])
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                groups.join(o, d)
        for x in s:
            held[x].append(d)
    return {d: (len(s), groups.find(d), groups.find(d) == d) for d, s in sets.items()}


def test_op5_matches_brute_force_on_tables(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op5_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute_near(texts)


def test_op5_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    """A cluster cut into many blocks gives the same components as all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", (8, 16))
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for d in range(120):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            w[at] = f"x{rng.integers(0, 10**6)}"
        texts.append((d, " ".join(w)))
    want = brute_near(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == want and 1 < len({v[1] for v in want.values()}) < 120


def test_op5_edges(spark):
    long = " ".join(f"t{i}" for i in range(25_000))
    texts = [(4, long), (2, long.upper()), (3, long + " end"), (5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  b"), (10, "b a"), (None, long), (8, "a b"), (11, "é B"), (12, "É b")]
    got = near_dedup.near_duplicates(documents(spark, texts, extra=["kept", "sig"])).collect()
    rows = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    n = 25_000 - 4
    assert rows == Counter(
        [(4, n, 2, False), (2, n, 2, True), (3, n + 1, 2, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (8, 1, 8, True),
         (9, 1, 8, False), (10, 1, 10, True), (None, None, None, True), (11, 1, 11, True), (12, 1, 12, True)])
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    kept = near_dedup.near_duplicates(documents(spark, texts), keep_columns=["doc_id", "text"])
    assert kept.count() == len(texts) and kept.where("kept").count() == 10


def test_runtime_filter_lets_all_keys_pass(spark):
    from pyspark.sql import functions as F

    from touchline.llm.common import attach, runtime_filter

    keys, rows = spark.range(0, 60_000, 3).toDF("k"), spark.range(100_000).toDF("k")
    passed = {r.k for r in rows.where(runtime_filter(keys, "k")(F.col("k"))).collect()}
    assert {r.k for r in keys.collect()} <= passed and len(passed) < 30_000
    assert rows.where(runtime_filter(keys.limit(0), "k")(F.col("k"))).count() == 0
    told = attach(rows.withColumn("g", F.col("k") % 3), ["g"], "k", {"n": (F.sum, F.lit(1)), "top": (F.max, F.struct("k"))})
    assert {tuple(r) for r in told.select("g", "n", "top.k").distinct().collect()} == {(0, 33_334, 99_999), (1, 33_333, 99_997), (2, 33_333, 99_998)}
    assert told.count() == 100_000


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    sets = Sets({x for ab in links for x in ab})
    for a, b in links:
        sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: sets.find(i) for ab in links if ab[0] != ab[1] for i in ab}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_write_few_files(spark, monkeypatch):
    """Files go by the number of links, not by that of shuffle partitions; with as few links a file, by partitions again."""
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    whole, parts = common.cut, []

    def counted(df):
        done = whole(df)
        parts.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(common, "cut", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for a_file, files in ((50_000, 1), (30, 2), (1, 4)):
            monkeypatch.setattr(common, "LINKS_A_FILE", a_file, raising=False)
            parts.clear()
            assert {r.component for r in components(links, "a", "b").collect()} == {0}
            assert len(parts) > 4 and set(parts[1:]) == {files}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_vectors(rows):
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    sets, n = Sets([i for i, _ in rows if i is not None]), Counter()
    ids = sorted(good)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = good[i], good[j]
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                sets.join(i, j)
                n.update((i, j))
    return {i: (n[i], sets.find(i), sets.find(i) == i) for i, _ in rows if i is not None}


@pytest.mark.parametrize("block", [1024, 16])
def test_op10_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((25, 24))
    rows = [(i, [float(x) for x in centers[min(i % 40, 24)] + rng.standard_normal(24) * rng.choice([0.1, 0.3, 0.5])]) for i in range(500)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None] * 12), (904, [float("inf")] + [0.0] * 23), (905, []),
             (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, rows[3][1]), (909, [1e-30 * x for x in rows[3][1]])]
    rows += [rows[5], rows[5], (None, rows[5][1]), (None, None)]
    df = spark.createDataFrame([(*r, "mine", "too") for r in rows], "vec_id long, embedding array<double>, n_links string, kept string")
    every = embedding_dedup.near_duplicates(df).collect()
    assert len(every) == len(rows) and [tuple(r) for r in every if r.vec_id is None] == [(None, 0, None, True)] * 2
    assert len({tuple(r) for r in every if r.vec_id == 5}) == 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in every if r.vec_id is not None}
    want = brute_vectors(dict((i, v) for i, v in rows if i is not None).items())
    assert got.keys() == want.keys()
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i] != want[i] for i in want) <= 5
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_op10_on_the_table(spark):
    """The whole table, with near and exact copies of some of its vectors, against all pairs."""
    table, rng = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding"), np.random.default_rng(8)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    made = [(10**6 + 10 * k + c, [float(np.float32(a + e)) for a, e in zip(v, rng.normal(0, s, len(v)) * np.linalg.norm(v))])
            for k, (_, v) in enumerate(rows[::9]) for c, s in enumerate((0, 0.02, 0.05, 0.06))]
    got = embedding_dedup.near_duplicates(table.unionByName(spark.createDataFrame(made, table.schema))).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    ids, x = [i for i, _ in rows + made], np.array([v for _, v in rows + made], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near, sets = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool), Sets(ids)
    for a, b in zip(*np.nonzero(near)):
        sets.join(ids[a], ids[b])
    want = {i: (int(n), sets.find(i), sets.find(i) == i) for i, n in zip(ids, near.sum(axis=1))}
    assert near.sum() > 1000 and got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.99 * near.sum() and sum(got[i] != want[i] for i in ids) <= 0.01 * len(ids)
    assert embedding_dedup.op10_embedding_dedup(spark, "/root/testdata/sf0.1").count() == len(rows)


def test_op10_codes_grow_without_end():
    bits = [embedding_dedup.shape(n, 0.9, 0.0005)[0] for n in (10, 10**4, 10**9, 10**12)]
    assert bits == sorted(bits) and bits[-1] > 30
    planes, x = embedding_dedup.Planes(*embedding_dedup.shape(10**6, 0.9, 0.0005), 1), np.random.default_rng(0).standard_normal((5, 8))
    assert (planes.codes(x)[:, :3] == planes.codes(x[:2], 3)[0]).any() and (planes.codes(x, 3) == planes.codes(x)[:, :3]).all()


def test_op2_counts_follow_the_weights(spark):
    docs = documents(spark, [(i, "t") for i in range(3000)], "a").unionByName(documents(spark, [(i, None) for i in range(3000, 4000)], None))
    got = mix_sources(docs, {"a": 1.0}, size=6000)
    n = got.count()
    assert abs(n - 6000) < 5 * 6000**0.5 and got.where("source is null").count() == 0
    again = mix_sources(docs.repartition(7), {"a": 1.0}, size=6000)
    assert again.exceptAll(got).count() == 0
    counts = Counter(r.n for r in got.groupBy("doc_id").agg({"copy": "count"}).toDF("doc_id", "n").collect())
    assert abs(counts[2] - 3000 * 2 * np.exp(-2)) < 120  # Poisson of mean 2
    assert mix_sources(docs.limit(0)).count() == 0
    assert abs(mix_sources(docs).count() - 4000) < 300


def test_op2_edges(spark):
    """Clashing names, null ids and sources, repeated rows and a very long text."""
    texts = [(1, None), (2, ""), (None, "no id"), (3, "word " * 200_000), (4, "same"), (4, "same")]
    got = mix_sources(documents(spark, texts, source=None, extra=["copy", "rate", "shuffle_key", "w"]), size=600).collect()
    n = Counter((r.doc_id, r.n_copies) for r in got)
    assert abs(len(got) - 600) < 250 and all(v == k[1] * (2 if k[0] == 4 else 1) for k, v in n.items()) and {k[0] for k in n} == {1, 2, 3, 4, None}
    assert all(r.rate == r.w == "mine" and isinstance(r.copy, int) for r in got) and {len(r.text) for r in got if r.doc_id == 3} == {1_000_000}


def test_op2_large_means_and_many_sources(spark, monkeypatch):
    docs = documents(spark, [(i, "t") for i in range(5)], "a")
    assert abs(mix_sources(docs, size=10_000).count() - 10_000) < 600
    from touchline.llm import mixing

    want = sorted(r.doc_id for r in mix_sources(docs).collect())
    monkeypatch.setattr(mixing.with_rates, "__defaults__", (0,))
    assert sorted(r.doc_id for r in mix_sources(docs).collect()) == want
    assert op2_mixing(spark, SF).count() > 0


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(tokenizer_path())
    return ids_of.t.encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, texts):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d, t in texts:
        ids = np.array(ids_of(t), dtype="<u4").tobytes()
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
            at += r.length
        assert at == len(ids) // 4
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
    return sum(ends.values()) / (2048 * len(ends))


def test_op7_round_trip(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_packing(op7_packing(spark, SF).collect(), texts) > 0.98


def test_op7_edges(spark):
    texts = [(1, None), (2, ""), (3, "Ünï code É́ ok <|endoftext|>x it's 123"), (4, "word " * 30_000), (5, "\x1c\x0b a"), (6, "İΣ ΑΣ ς")]
    rows = packed_digests(documents(spark, texts, extra=["ids"])).collect()
    check_packing(rows, texts)
    none = [(None, "no id"), (None, "no id"), (None, None)]
    assert sorted((r.doc_tokens, r.length) for r in packed_digests(documents(spark, none)).collect() if r.doc_id is None) == sorted((n, n) for n in map(len, map(ids_of, (t for _, t in none))))
    twice = packed_digests(documents(spark, texts[:3] + texts[:3])).collect()
    assert len(twice) == 6 and len({(r.sequence_id, r.offset) for r in twice}) == 6
    assert packed_digests(documents(spark, [])).count() == 0
    assert encode_words(tokenizer_path(), [[]]) == [b""]


def test_op7_ranks_over_many_groups_of_bins(spark, monkeypatch):
    from touchline.llm import packing

    monkeypatch.setattr(packing, "BINS_A_GROUP", 3)
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "if(id % 3 = 0, 2048L, id % 7 + 1) AS length", "'mine' AS n")
    got = packing.pack(pieces, rank_rows=20).collect()
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id] and r.n == "mine"
        ends[r.sequence_id] += r.length
    assert len(got) == 3000 and max(ends.values()) == 2048 and sorted(ends) == list(range(len(ends)))


def test_packing_patterns_hold_the_histogram():
    rng = np.random.default_rng(7)
    histogram = Counter(rng.integers(1, 2049, 5000).tolist() + [7] * 4000)
    patterns = pack_histogram(histogram)
    held = Counter()
    for n, p in patterns:
        assert sum(p) <= 2048
        for x in p:
            held[x] += n
    assert held == histogram

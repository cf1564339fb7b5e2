import itertools
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import filter_audit, hard_negatives
from touchline.llm.filter_audit import OP12_SQL, Scanner, audit, masks_of, op12_filter_audit, scanned
from touchline.llm.hard_negatives import OP11_SQL, mine, op11_hard_negatives, quantised, scores
from touchline.llm.toxicity import Compressors, op13_toxicity, score_toxicity, text_parts, windows

from .helpers import SF, documents

SF01 = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int"


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def sql_rows(query, folder=SF01):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.sql(query)
    return sorted(tuple(r[got.columns.index(c)] for c in sorted(got.columns)) for r in got.fetchall())


def plain_mine(rows, every=100):
    """Hard negatives by comparing every anchor with every row, in Python's whole numbers."""
    keep = []
    for i, x, label in dict.fromkeys((i, None if x is None else tuple(x), y) for i, x, y in rows):
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        keep.append((i, [math.floor(256 * v) for v in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, x, y in keep:
        if i % every:
            continue
        known = sorted((-sum(a * b for a, b in zip(x, z, strict=True)), j, w == y) for j, z, w in keep if j != i and len(z) == len(x))
        for positive in [k for k in known if k[2]][:5]:
            p = -positive[0]
            fit = [k for k in known if not k[2] and 80 * p <= -100 * k[0] <= 100 * p][:5]
            out += [(i, k[1], -k[0], positive[1], p, n + 1) for n, k in enumerate(fit)]
    return sorted(out)


def test_op11_equals_sql_and_brute_force(spark, monkeypatch):
    want = sql_rows(OP11_SQL)
    assert rows_of(op11_hard_negatives(spark, SF01)) == want and len(want) > 50
    monkeypatch.setattr(hard_negatives, "SCORES_AT_ONCE", 1000)
    vectors = spark.read.parquet(f"{SF01}/embeddings.parquet")
    assert rows_of(mine(vectors)) == plain_mine([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])


def test_op11_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    some = [(int(i), rng.integers(-3, 4, 4).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(400)]  # many equal scores
    rows = some + some[:130] + [(100, [0.5, 0.5, 0.5, 0.5], 1), (101, [0.5, 0.5, 0.5, 0.5], None), (102, None, 1), (103, [1.0, None, 1.0, 1.0], 1)]
    rows += [(104, [math.nan] * 4, 1), (None, [1.0] * 4, 1), (500, [2.0, 2.0], 1), (501, [2.0, 2.0], 1), (502, [1.7, 2.0], 2), (600, [], 1), (601, [], 1), (603, [], 2), (-200, [1.0] * 4, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("rid", "key", "stripe", "place", "score")})
    assert rows_of(mine(df)) == plain_mine(rows)
    assert rows_of(mine(df.repartition(7))) == plain_mine(rows)
    assert mine(df.limit(0)).count() == 0
    assert mine(spark.createDataFrame([(100, [1.0], 1)], VECTORS)).count() == 0


def test_op11_scores_are_exact_whatever_their_size():
    a = quantised([np.array([2.0**30 + 1 / 256, 3.0]).tobytes()], "<f8")
    b = quantised([np.array([2.0**8 + 1 / 256, -1 / 256]).tobytes()], "<f8")
    assert scores(a, b)[0, 0] == (2**38 + 1) * (2**16 + 1) - 768
    huge = quantised([np.array([1e308, 0.0]).tobytes()], "<f8")
    assert scores(huge, huge)[0, 0] == 2**63 - 1 and scores(huge, -huge)[0, 0] == -(2**63)


def plain_audit(docs, labels):
    """The audit by running every order over every document."""
    quality, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, lang in docs:
        text = text or ""
        words, failed = text.encode().split(), set()
        failed |= {"A"} if len(words) < 100 else set()
        failed |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        failed |= {"D"} if set(text) & set("#$%&*|") else set()
        failed |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        fails.append((lang or "", failed, i in quality, i in toxic))
    out = []
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        shapley = {k: 0 for k in "ABCDE"}
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, k in enumerate(order, 1):
                here = [f for f in left if k in f[0]]
                left = [f for f in left if k not in f[0]]
                shapley[k] += len(here)
                failing = sum(k in f[0] for f in own)
                rows.append((order, step, k, len(left), len(here), failing - len(here), sum(f[0] == {k} for f in own), sum(f[1] for f in here), sum(f[2] for f in here)))
        out += [{"part": part, "filter_order": o, "step": s, "kept": n, "removed": r, "redundant": d, "unique_fails": u, "good_lost": g, "toxic_lost": t, "shapley": shapley[k]} for o, s, k, n, r, d, u, g, t in rows]
    return sorted(tuple(r[c] for c in sorted(r)) for r in out)


def test_op12_equals_sql_and_brute_force(spark):
    got = rows_of(op12_filter_audit(spark, SF01))
    assert got == sql_rows(OP12_SQL)
    assert rows_of(op12_filter_audit(spark, SF)) == sql_rows(OP12_SQL, SF)


def test_op12_odd_rows(spark):
    long = "Wort " * 300 + "x" * 5000 + " " + "y" * 5000 + " é" * 20
    docs = [(1, None, "en"), (2, "", None), (3, "", ""), (4, "A B\x0bC\x0c#", "en"), (4, "A B\x0bC\x0c#", "en"), (5, "A B\x0bC\x0c#", "de"), (None, "A B\x0bC\x0c#", "en"),
            (6, long, "de"), (7, long, "de"), (None, "", "fr"), (9, " ".join(f"w{k}" for k in range(120)), "en"), (10, "ÄÖÜ " * 150, "de"), (-1, "", "en")]
    labels = [(1, 1, 0), (1, 0, 1), (6, 1, 1), (9, 1, None), (10, None, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("mine") for c in ("part", "mask", "digest", "row", "least", "quality")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("mine"))
    assert rows_of(audit(df, known)) == plain_audit(docs, labels)
    assert audit(df.limit(0), known).count() == 0
    assert rows_of(audit(df, known.limit(0))) == plain_audit(docs, [])


def test_op12_scan_of_any_cut(monkeypatch):
    """Counts do not depend on where texts are cut, on slices of a batch, or on hashes being apart."""
    texts = ["", " ", "a a\tb", "Ab" * 40 + " " + "Ab" * 40 + "c", None, "x " * 500, "é# " * 300, "word", "w" * 3000 + " w", "\n\x0b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "lang": [None] * len(texts)})
    want = []
    for t in texts:
        w = (t or "").encode().split()
        want.append(int(masks_of(*np.array([[len(w), len(set(w)), sum(c.isupper() and c.isascii() for c in t or ""), sum(c in "#$%&*|" for c in t or ""), len(t or "")]]).T)[0]))
    for chunk in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(filter_audit, "CHUNK", chunk)
        assert scanned(batch, Scanner())["mask"].to_pylist() == want
        assert scanned(batch.slice(2, 5), Scanner())["mask"].to_pylist() == want[2:7]
    s = Scanner()
    s.up = np.zeros_like(s.up)  # every word has the same hash
    data = np.frombuffer(b"a b a  cc" + b"z z z", dtype=np.uint8)
    assert [x.tolist() for x in s.scan(data, np.array([0, 9, 9, 14]))[:2]] == [[4, 0, 3], [3, 0, 1]]


def test_op13_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op13_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in labels if got[r.doc_id].held_out]
    caught, wrong = sum(r.predicted for r, t in held if t), sum(r.predicted for r, t in held if not t)
    assert caught >= 0.6 * sum(t for _, t in held) and wrong <= 0.005 * len(held)
    assert abs(np.mean([r.score for r, _ in held]) - np.mean([t for _, t in held])) < 0.03


def test_op13_scores_texts_alone(spark):
    """Neither lang, source and id nor the labels of held-out rows change a score, and every text counts to its end."""
    rng = np.random.default_rng(3)
    words = "the river ran past old mill and on to town we walked along road until it was dark they sold bread fruit in square".split()
    text = lambda toxic: " ".join(w + (" vile grobnik" if toxic and k % 10 == 5 else "") for k, w in enumerate(rng.choice(words, 40)))
    made = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(400)]
    docs = [(i, t) for i, t, _ in made] + [(1000, None), (1001, ""), (1002, "!?"), (None, "the grobnik"), (None, None), (1003, "the road " * 80_000 + "vile grobnik " * 8_000), (1004, "the road " * 80_000), (0, made[0][1])]
    df = documents(spark, docs, extra=["h", "toxic", "fold", "k0", "first"])
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in made] + [(1000, None), (1001, 7), (None, 1), (5000, 1)], "doc_id long, toxic int").withColumn("text", F.lit("mine"))
    got = {}
    for r in score_toxicity(df, labels).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.held_out, r.predicted))
    assert all(got[i][0][2] == t for i, _, t in made) and len(got[0]) == 2 and len(set(got[0])) == 1
    assert got[1003][0][0] > got[1004][0][0] and got[1004][0][2] == 0
    assert len({got[i][0][0] for i in (1000, 1001, 1002)}) == 1 and len(got[None]) == 2 and not got[None][0][1]
    false = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in score_toxicity(df.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}), false).collect()}
    assert all(again[i] == got[i][0][0] for i in again if i is not None)
    one = score_toxicity(df, labels.where("toxic = 0")).collect()
    assert len({r.score for r in one}) == 1 and score_toxicity(df.limit(0), labels).count() == 0
    assert {r.score for r in score_toxicity(df, labels.limit(0)).collect()} == {0.5}


def test_op13_windows_cover_every_word():
    for text in ("", " ", "one", "one two", "One, two; three", "a b c d e f g", "x" * 50):
        for part in text_parts(text):
            cut = [part[a:b] for a, b in windows(part).tolist()]
            assert all(c[:1] == c[-1:] == b" " for c in cut)
            assert b" ".join(c.strip() for c in cut).split() == part.split() == text.lower().replace(",", "").replace(";", "").encode().split()


@pytest.mark.parametrize("toxic", [b"", b"\n grobnik "])
def test_op13_windows_without_toxic_bytes_gain_nothing(toxic):
    pair = Compressors(b"the river ran past the old mill " * 20, toxic)
    h = pair.histogram("the river ran past the mill")
    assert h[3] == h.sum() == 3
    assert (pair.histogram("the grobnik ran past")[4:].sum() > 0) == bool(toxic)

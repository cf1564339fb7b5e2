import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from touchline.llm.line_dedup import dedup_lines, fingerprints, op6_line_dedup, repeated_lines
from touchline.llm.quality_rules import BUCKETS, op8_quality_rules, score_documents

from .helpers import SF, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_op8_base_statistics_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op8_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_op8_scores_match_brute_force(spark):
    """Score and verdict of every document, from counts made by plain loops."""
    import math

    from touchline.llm.quality_rules import SMOOTHING, THRESHOLD

    def signed(h):
        return h - (h >> 63 << 64)

    def chained(a, b):  # xxhash64 of two longs: the hash of the second, seeded with that of the first
        h = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed=42)
        return signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=h))

    def buckets(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in WORD.findall(text or "")]
        return [x % BUCKETS for x in h] + [chained(a, b) % BUCKETS for a, b in zip(h, h[1:])]

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and r.toxic == 0}
    grams = {d: buckets(t) for d, t in texts.items()}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if d in trusted:
            target.update(g)
    wide, narrow, prior = sum(raw.values()), sum(target.values()), SMOOTHING * BUCKETS
    ratio = {b: round(math.log((target[b] * wide / n + prior) / (narrow + prior)), 6) for b, n in raw.items()}
    for r in op8_quality_rules(spark, SF).collect():
        g = grams[r.doc_id]
        want = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert abs(r.score - want) < 1e-8, r.doc_id
        assert r.kept == (not r.base_failed and r.score >= THRESHOLD)


def test_op8_keeps_good_and_rejects_bad(spark):
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r for r in op8_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    good = [got[d].kept for d, r in labels.items() if r.quality == 1 and not got[d].base_failed]
    bad = [got[d].kept for d, r in labels.items() if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


EDGES = [(1, None), (2, ""), (3, "\x1c a b\t\x0bc"), (4, "a b c d e " * 5), (4, "a b c d e " * 5), (5, "𝒳𝒴 # <b>\n𝒳𝒴 # <b>\n \n "), (6, "x"), (None, "one two three"), (7, "w " * 30000)]


def test_op8_edges(spark):
    got = score_documents(documents(spark, EDGES, extra=["score", "kept", "w"]), documents(spark, [(1, "")]).select("doc_id")).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *base(t)) for i, t in EDGES)
    assert all(r.score is not None and r.w == "mine" for r in got)
    none = documents(spark, [])
    assert score_documents(none, none.select("doc_id")).count() == 0


def test_op8_ratio_follows_the_target(spark):
    docs = documents(spark, [(i, "alpha beta gamma delta " * 5 if i < 5 else "$$$ %%% *** zzz " * 5) for i in range(10)])
    got = {r.doc_id: r.score for r in score_documents(docs, docs.where("doc_id < 3").select("doc_id"), smoothing=0.001).collect()}
    assert got[4] > 0 > got[7] and BUCKETS == 1 << 15


def test_op6_keeps_the_first_and_deletes_later_runs(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue white black brown grey pink gold lime"
    rows = [
        (1, f"{a}\n{b}\nfirst own line here"), (2, f"second own line\n{a}\n\n{b}\nmore of two"), (3, f"{a}\n{b}"), (4, None), (5, ""), (6, "\n\n"),
        (None, f"{a}\n{b}"), (7, "short\nshort\nshort"), (3, f"{a}\n{b}"), (8, f"{b}\n{a} x\ntail of eight is its own"), (9, f"x\n{a}\n{b}\n{a}\n{b}\ny"),
    ]
    found = dedup_lines(documents(spark, rows, extra=["gone", "emptied", "first", "line"])).collect()
    assert [(r.text, r.emptied, r.n_removed, r.n_lines) for r in found if r.doc_id == 4] == [(None, False, 0, 0)]
    got = sorted((r.doc_id or 0, r.text, r.emptied, r.n_removed) for r in found if r.doc_id != 4)
    assert got == [
        (0, f"{a}\n{b}", False, 0), (1, rows[0][1], False, 0), (2, "second own line\n\nmore of two", False, 2), (3, "", True, 2), (3, "", True, 2),
        (5, "", False, 0), (6, "\n\n", False, 0), (7, "short\nshort\nshort", False, 0), (8, f"{a} x\ntail of eight is its own", False, 1), (9, "x\ny", False, 4),
    ]
    assert dedup_lines(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_winnowing_guarantee(seed):
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 2**63, 12, dtype=np.uint64)
    words = rng.integers(1, 12, 12)
    if words.sum() < 20:
        words[0] += 20
    picks = []
    for _ in range(2):
        before, after = rng.integers(0, 9), rng.integers(0, 9)
        h = np.concatenate((rng.integers(0, 2**63, before, dtype=np.uint64), shared, rng.integers(0, 2**63, after, dtype=np.uint64)))
        n = np.concatenate((rng.integers(1, 12, before), words, rng.integers(1, 12, after)))
        picks.append(set(fingerprints(h, n, 10, 20)[1]))
    assert picks[0] & picks[1]


def plain_winnowing(texts, noise, guarantee):
    """Numbers of the lines to delete by document, by plain loops; runs go on along the earlier document without end."""
    docs = {d: [(i, x.strip(), len(x.split())) for i, x in enumerate(t.encode().split(b"\n")) if x.split()] for d, t in texts}
    first, posts = {}, []
    for d in sorted(docs):
        lines = docs[d]

        def upto(i, words):
            n = 0
            while n < words and i < len(lines):
                n, i = n + lines[i][2], i + 1
            return i if n >= words else None

        spans = [(i, upto(i, noise)) for i in range(len(lines))]
        grams = {i: tuple(x[1] for x in lines[i:end]) for i, end in spans if end}
        hashes = {i: xxhash.xxh64_intdigest(np.array([xxhash.xxh64_intdigest(x) for x in g], dtype=np.uint64).tobytes()) for i, g in grams.items()}
        chosen = set()
        for i in range(len(lines)):
            if end := upto(i, guarantee):
                chosen.add(min((k for k in range(i, end) if k in grams and spans[k][1] <= end), key=hashes.get))
        for i in sorted(chosen):
            posts.append((d, i, spans[i][1], grams[i]))
            first.setdefault(grams[i], (d, i))
    gone = {}
    for d, i, end, gram in posts:
        e, k = first[gram]
        if (e, k) != (d, i):
            mine, other, lo, hi = docs[d], docs[e], 0, 0
            while min(i, k) > lo and mine[i - lo - 1][1] == other[k - lo - 1][1]:
                lo += 1
            while i + hi < len(mine) and k + hi < len(other) and mine[i + hi][1] == other[k + hi][1]:
                hi += 1
            gone.setdefault(d, set()).update(x[0] for x in mine[i - lo : i + hi])
    return gone


@pytest.mark.parametrize(("noise", "guarantee"), [(3, 3), (4, 9)])
def test_op6_matches_a_plain_winnowing(spark, noise, guarantee):
    rng = np.random.default_rng(noise)
    shared = [[" ".join(f"s{k}_{j}_{w}" for w in range(rng.integers(1, 6))) for j in range(12)] for k in range(4)]
    made = []
    for d in range(60):
        lines = [" ".join(f"d{d}_{j}_{w}" for w in range(rng.integers(1, 6))) for j in range(rng.integers(0, 8))]
        k, a = rng.integers(0, 4), rng.integers(0, 10)
        made.append((10**6 + d, "\n".join([*lines, *shared[k][a : a + rng.integers(1, 9)], "", f"end {d}"])))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(documents(spark, made).select("doc_id", "text"))
    want = plain_winnowing([(r.doc_id, r.text or "") for r in docs.collect()], noise, guarantee)
    got = {r.doc_id: set(r.gone) for r in repeated_lines(docs, noise, guarantee).collect()}
    if noise == guarantee:  # every run beyond a gram has a gram of its own or is too short for one
        assert got == want
    else:  # along another document a run may end sooner
        assert got.keys() == want.keys() and all(got[d] <= want[d] for d in got)
        assert sum(map(len, got.values())) > 0.95 * sum(map(len, want.values()))
    left = {r.doc_id: r.text for r in dedup_lines(docs, noise, guarantee).collect()}
    for d, t in ((r.doc_id, r.text or "") for r in docs.collect()):
        kept = [x for i, x in enumerate(t.split("\n")) if i not in got.get(d, ())]
        assert left[d] == ("\n".join(kept) if WORD.search("\n".join(kept)) or d not in got else "")


def test_op6_query_is_the_plain_winnowing_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    gone = plain_winnowing(texts.items(), 3, 3)
    got = {r.doc_id: (r.text, r.n_removed, r.emptied) for r in op6_line_dedup(spark, SF).collect()}
    for d, t in texts.items():
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))
        emptied = d in gone and not WORD.search(left)
        assert got[d] == ("" if emptied else left, len(gone.get(d, ())), emptied)
    assert got.keys() == texts.keys()


def test_op6_deletes_every_repeated_line(spark):
    """Of all lines of three words or more only the first of equals stays; of shorter ones, less than three words of a repeated run."""
    a, b = "the nine words of this line stand alone here", "of four words only"
    made = [(10**6 + i, f"own text {i} of this\n{a if i % 2 else b}\nand its end {i} too\nred\none two\nmore own {i} text") for i in range(6)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(documents(spark, made).select("doc_id", "text"))
    gone = {r.doc_id: set(r.gone) for r in repeated_lines(docs).collect()}
    seen, grams, n = set(), set(), 0
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        lines = [(i, x.strip(), len(x.split())) for i, x in enumerate(text.encode().split(b"\n")) if x.split()]
        out = gone.get(doc_id, set())
        for k, (i, line, words) in enumerate(lines):
            assert (i in out) == (line in seen) if words >= 3 else i not in out or line in seen, (doc_id, i)
            n += words >= 3 and i in out
            seen.add(line)
            end = k
            while end < len(lines) and words < 3:
                end += 1
                words += lines[end][2] if end < len(lines) else 0
            if words >= 3:
                gram = tuple(x[1] for x in lines[k : end + 1])
                assert gram not in grams or any(x[0] in out for x in lines[k : end + 1]), (doc_id, i)
                grams.add(gram)
    assert n > 1000 and all(gone[10**6 + i] >= {1, 3, 4} for i in range(2, 6))

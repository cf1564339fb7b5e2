import pytest

from .helpers import SF, documents
from .test_dedup_mix_pack import brute_near


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    quality, lines, near, mixed, packed = kept
    assert 50 < len(quality) < 200 and len(lines) <= len(quality)
    groups = brute_near([(r.doc_id, r.text) for r in lines])
    assert {r.doc_id for r in near} == {d for d, (_, _, first) in groups.items() if first}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near}
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)
    once = {r.doc_id: r.text for r in mixed}
    firsts = {r.doc_id for r in packed}
    single = [(d, t) for d, t in once.items() if sum(r.doc_id == d and r.start == 0 for r in packed) == 1]
    assert firsts == set(once)
    check_packing_part(packed, single)


def check_packing_part(rows, texts):
    ids = {d for d, _ in texts}
    by = [r for r in rows if r.doc_id in ids]
    from .test_dedup_mix_pack import ids_of

    for d, t in texts:
        assert sum(r.length for r in by if r.doc_id == d) == len(ids_of(t))


def test_near_stage_links_from_four_fifths(spark):
    """Copies between 0.80 and 0.85, which op5's contract leaves alone, go as well; those below 0.80 stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = [(10**6 + k, " ".join(f"w{k}_{i}" for i in range(104))) for k in range(40)]
    made += [(2 * 10**6 + k, f"{t} " + " ".join(f"x{k}_{i}" for i in range(25 + k % 2))) for k, (_, t) in enumerate(made)]  # 100 of 125 or 126
    rows = docs.select("doc_id", "text").unionByName(documents(spark, made).select("doc_id", "text"))
    got = {r.doc_id for r in corpus_pipeline.near(spark, documents_like(rows), SF).collect()}
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    want = {d for d, (_, _, first) in brute_near(texts, 80).items() if first}
    assert got == want and len(want) < len({d for d, (_, _, first) in brute_near(texts, 85).items() if first})
    assert {d for d in got if d >= 2 * 10**6} == {2 * 10**6 + k for k in range(1, 40, 2)}


def documents_like(rows):
    from pyspark.sql import functions as F

    return rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))


PROSE = "The board said on that day that it had been told of the plan by the {} and would not wait for the rest of the year"


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, empty tables."""
    from pyspark.sql import functions as F

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    whole = [(i, PROSE.format(" ".join(f"n{i}x{k}" for k in range(8))), "en", "s", 9) for i in range(6)]
    odd = [(10, None, None, None, None), (11, "", "en", "s", 0), (12, " \n\t", "en", "s", 3), (None, whole[1][1], "en", None, 9), whole[0], (13, "\n".join(f"{PROSE.format(k)} {k}" for k in range(3000)), "en", "s", 1)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame(whole + odd, schema).withColumns({c: F.lit("mine") for c in ("kept", "__id", "score", "n_copies", "length", "gone")})
    ids = lambda df: sorted((r.doc_id is None, r.doc_id) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    every = ids(docs)
    left = {name: stage(spark, docs, SF) for name, stage in stages.items()}
    assert all(left[name].columns == corpus_pipeline.COLUMNS for name in list(stages)[:-1])
    assert {10, 11, 12}.isdisjoint({i for _, i in ids(left["quality_rules"])}) and set(ids(left["quality_rules"])) <= set(every)
    # The repeated row is one document and stays; nothing else repeats a line but the row without an id, which is not compared.
    assert ids(left["line_dedup"]) == every
    assert {r.doc_id: r.n_chars for r in left["line_dedup"].collect() if r.text is not None and r.doc_id == 0} == {0: len(whole[0][1])}
    assert ids(left["near_dedup"]) == every
    assert set(ids(left["mixing"])) <= set(every)
    pieces = left["packing"].collect()
    starts = [r for r in pieces if r.start == 0]
    assert sorted((r.doc_id is None, r.doc_id) for r in starts) == every and sum(r.length for r in pieces) == sum(r.doc_tokens for r in starts)
    assert [r.doc_tokens for r in starts if r.doc_id in (10, 11, 12)] == [1, 1, 1]
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_stages_quality_lines_and_mixing_match_plain_forms(spark):
    """Stage 1 against the verdicts of op8, stage 2 against plain winnowing, stage 4 against Poisson quantiles."""
    import hashlib
    import math

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from touchline.llm.quality_rules import op8_quality_rules

    from .test_rules_and_lines import plain_winnowing

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in stages["quality_rules"](spark, docs, SF).collect()} == {r.doc_id for r in op8_quality_rules(spark, SF).collect() if r.kept}
    gone = plain_winnowing(texts.items(), 3, 3)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in texts.items()}
    want = {d: t for d, t in want.items() if d not in gone or t.split()}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"](spark, docs, SF).collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()}
    sources = [r.source for r in docs.collect()]
    weight = {s: sources.count(s) ** 0.5 for s in sources}
    copies = {}
    for r in docs.collect():
        mean = len(sources) * weight[r.source] / (sum(weight.values()) * sources.count(r.source))
        u, k, p = int(hashlib.md5(f"20:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-mean)
        total = p
        while total <= u:
            k += 1
            p *= mean / k
            total += p
        copies[r.doc_id] = k
    mixed = [r.doc_id for r in stages["mixing"](spark, docs, SF).collect()]
    assert {d: mixed.count(d) for d in copies} == copies

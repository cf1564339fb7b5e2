import numpy as np

from touchline.llm.line_dedup import WINDOW_LINES, dedup_lines, minima, repeated_lines, sketch_lines

from .helpers import documents

SF01 = "/root/testdata/sf0.01"


def test_windows_select_two_grams_in_seven_and_guarantee_runs():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    at = minima(grams)
    assert abs(len(at) / len(grams) - 2 / (WINDOW_LINES + 1)) < 0.02 and np.diff(at).max() <= WINDOW_LINES
    for n in (WINDOW_LINES, 9, 30):  # whatever stands around it, a run of a window or more holds a common selected gram
        run = rng.integers(0, 2**63, n, dtype=np.uint64)
        picks = []
        for _ in range(2):
            around = [rng.integers(0, 2**63, k, dtype=np.uint64) for k in rng.integers(0, 9, 2)]
            whole = np.concatenate((around[0], run, around[1]))
            picks.append({int(g) for g in whole[minima(whole)]} & {int(g) for g in run})
        assert picks[0] & picks[1]
    assert minima(grams[:0]).tolist() == [] and len(minima(grams[:3])) == 1


def test_the_first_pass_selects_few_lines_of_the_table(spark):
    posts = sketch_lines(spark.read.parquet(f"{SF01}/documents.parquet"), 3, 3)
    n = {r.windows: r["count"] for r in posts.groupBy("windows").count().collect()}
    assert n[True] < 0.4 * n[False]


def bare(text):
    return [x.strip() for x in (text or "").split("\n") if x.split()]


def test_every_deleted_line_is_in_a_run_with_its_source(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    n = longest = 0
    for r in repeated_lines(docs).collect():
        own = texts[r.doc_id].split("\n")
        covered = {k for run in r.runs for k in range(run.first_line, run.last_line + 1)}
        assert covered == set(r.gone)
        for run in r.runs:
            lines, source = [x.strip() for x in own[run.first_line : run.last_line + 1]], bare(texts[run.source_id])
            assert any(source[k : k + len(lines)] == lines for k in range(len(source))) and run.source_id <= r.doc_id
            n, longest = n + 1, max(longest, len(lines))
    assert n > 200 and longest > WINDOW_LINES


def test_long_runs_are_deleted_whole_short_lines_and_all(spark):
    """A passage of many lines, short ones among them, is one run, with blank lines of its own in each copy."""
    passage = [f"line {k} of the passage stands here" if k % 3 else f"no {k}" for k in range(1, 30)]
    text = lambda i, gap: "\n".join([f"this is the head of text {i}", *passage[:gap], "", *passage[gap:], f"and this is the end of text {i}"])
    rows = [(i, text(i, 3 + i)) for i in range(5)] + [(10, "head of ten is here\nline 5 of the passage stands here\ntail of ten is here")]
    names = ["id", "key", "gone", "lines", "__id", "__key", "__gone", "__lines", "runs", "first", "windows", "_id"]
    got = {r.doc_id: r for r in dedup_lines(documents(spark, rows, extra=names)).collect()}
    for i in range(1, 5):
        assert got[i].text == f"this is the head of text {i}\n\nand this is the end of text {i}" and got[i].n_removed == 29
        assert {run.source_id for run in got[i].runs} == {0}
    assert got[0].runs == [] and got[10].text == "head of ten is here\ntail of ten is here" and got[10].runs[0].source_line == 6
    assert all(r[n] == "mine" for r in got.values() for n in names if n != "runs")


def test_op7_sub_bins_are_even_for_rows_without_an_id(spark):
    """Pieces that are alike in every column are dealt out over a length's sub-bins like others."""
    from collections import Counter

    from touchline.llm.packing import pack

    pieces = spark.range(4000).selectExpr("CAST(NULL AS bigint) AS doc_id", "0L AS start", "7L AS length")
    got = pack(pieces, rank_rows=50).collect()
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert len(got) == 4000 and max(ends.values()) <= 2048

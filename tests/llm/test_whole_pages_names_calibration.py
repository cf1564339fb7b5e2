import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import embedding_dedup, html_extraction
from touchline.llm.embedding_dedup import bucket_links, near_duplicates, unmet
from touchline.llm.html_extraction import extract_text, parse, places
from touchline.llm.mixing import mix_sources
from touchline.llm.quality_classifier import op9_quality_classifier, train
from touchline.llm.quality_rules import score_documents

from .helpers import documents

P = "The committee said that it would not be able to meet before the end of the year, and that the plan had to wait for more of the data."
Q = "They were told by the office that all of this had been known for some time, but that it was not up to them to say so in the open."


def plain_text(html):
    """Both passes by plain loops over the parsed blocks."""
    blocks, parts = parse(html or "")
    where, labels = places(blocks, parts), []
    for (text, words, stops, linked, _, _, _), place in zip(blocks, where, strict=True):
        share, length = stops / max(words, 1), len(text)
        if place < 0:
            labels.append(-2)
        elif place > 0:
            labels.append(-1 if linked > 0.6 * length and share < 0.1 else 1 if length >= 60 and share >= 0.1 else 0)
        elif linked > 0.3 * length:
            labels.append(-1)
        elif length < 60:
            labels.append(0)
        else:
            labels.append(1 if share >= 0.2 or (length >= 160 and share >= 0.1) else -1 if share < 0.1 else 0)
    article, kept = 1 in where, []
    known = [i for i, x in enumerate(labels) if x and (x >= -1 or not article)]
    for i, label in enumerate(labels):
        if label == 0 and known:
            least = min(abs(i - k) for k in known)
            sides = [k for k in known if abs(i - k) == least]
            label = labels[sides[-1] if blocks[i][6] else sides[0]]
        elif label == 0:
            label = 1 if article else -1
        if label > 0:
            kept.append(blocks[i][0])
    return " ".join(kept)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_op1_is_the_plain_two_passes_on_every_page(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    for rows in (pages, bare):
        html = {r.page_id: r.html for r in rows.collect()}
        for r in extract_text(rows).collect():
            assert r.text == plain_text(html[r.page_id]), r.page_id


NAMED = ["has-sidebar", "with-menu", "nav-open", "layout-header-fixed", "page-with-toc", "promo-theme", "newsletter-page", "social-enabled", "skip-layout", "widget-area", "comments-open", "share cookie"]


def test_op1_loses_no_page_to_its_mark_up(spark):
    both = f"<p>{P}</p><p>{Q}</p>"
    rows = [(c, f'<body><div id="page" class="{c}"><div class="content">{both}</div></div></body>', f"{P} {Q}") for c in NAMED]
    rows += [
        ("form", f"<body><form id=f method=post><div>{both}</div></form></body>", f"{P} {Q}"),
        ("role", f"<body><div role=form><fieldset>{both}</fieldset></div></body>", f"{P} {Q}"),
        ("quote in a value", f"<body><img alt=it's><p>{P}</p><p title=Don't>{Q}</p></body>", f"{P} {Q}"),
        ("quote without a value", f"<body><p a'b>{P}</p><p \">{Q}</p></body>", f"{P} {Q}"),
        ("quoted", f"<body><p title = \"a>b\" class='c>d'>{P}</p><p>{Q}</p></body>", f"{P} {Q}"),
        ("two halves", f'<body><div class="menu-left"><p>{P}</p></div><div class="menu-right"><p>{Q}</p></div></body>', f"{P} {Q}"),
        ("hint in the article", f'<body><article><div class="sidebar-layout">{both}</div></article></body>', f"{P} {Q}"),
        # and what must go, goes
        ("sidebar", f'<body><div class="has-sidebar"><div class="sidebar"><p>{P}</p></div><div><p>{Q} {Q}</p><p>{P} {Q}</p></div></div></body>', f"{Q} {Q} {P} {Q}"),
        ("notice", f'<body><article><p>Short one.</p></article><div class="cookie-notice"><p>{P}</p></div></body>', "Short one."),
        ("form beside", f"<body><main><p>{P} {Q}</p><form><p>{Q}</p></form></main></body>", f"{P} {Q}"),
        ("comments", f'<body><div><p>{P}</p></div><div id="comments"><p>{Q}</p><p>{Q} {Q}</p></div></body>', P),
    ]
    df = spark.createDataFrame([(i, "u", h) for i, h, _ in rows], "page_id string, url string, html string")
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    assert got == {i: t for i, _, t in rows}


def test_columns_of_any_name_are_kept(spark):
    names = ["blocks", "labels", "__blocks", "__labels", "rate", "_rate", "of", "salt", "salt2", "__source", "__rate", "verdict", "_verdict", "__v", "h"]
    docs = documents(spark, [(1, "one two three"), (2, None)], extra=names)
    pages = docs.selectExpr("*", "text AS html")
    for got in (extract_text(pages), mix_sources(docs, size=500), score_documents(docs, docs.select("doc_id"))):
        rows = got.collect()
        assert rows and all(r[n] == "mine" for r in rows for n in names)


def test_op9_probabilities_are_calibrated():
    """On made data with four good rows in five, scores of fresh rows mean what they say."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 20))
    y = (rng.random(6000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + x[:, 1] * x[:, 2] + 1.9)))).astype(float)
    net = train(x[:3000], y[:3000])
    p, truth = net.score(x[3000:]), y[3000:]
    assert abs(p.mean() - truth.mean()) < 0.03
    for lo, hi in ((0, 0.5), (0.5, 0.8), (0.8, 1)):
        held = (p >= lo) & (p < hi)
        assert abs(p[held].mean() - truth[held].mean()) < 0.08
    loss = lambda q: -np.mean(truth * np.log(q) + (1 - truth) * np.log(1 - q))
    bare = 1 / (1 + np.exp(-np.clip(net.logit(x[3000:]), -30, 30)))
    assert loss(np.clip(p, 1e-9, 1 - 1e-9)) <= loss(np.clip(bare, 1e-9, 1 - 1e-9)) + 1e-4 and net.temperature != 1


def test_op9_mean_score_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, quality[r.doc_id]) for r in op9_quality_classifier(spark, sf).collect() if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    p, y = np.array([x for x, _ in got]), np.array([x for _, x in got])
    assert abs(p.mean() - y.mean()) < 0.03 and np.mean((p >= 0.5) == y) > 0.93


def test_op10_counts_classes_of_equal_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6, 16))
    rows = [(i, x[i % 3].tolist()) for i in range(90)] + [(100 + i, (x[0] + 1e-3 * rng.standard_normal(16)).tolist()) for i in range(5)]
    rows += [(300, x[4].tolist()), (300, x[5].tolist()), (301, x[4].tolist()), (302, x[5].tolist())]  # an id with two vectors
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0] == (34, 0) and got[1] == (29, 1) and got[104] == (34, 0) and got[100][0] == 34
    assert got[300] == (2, 300) and got[301] == (1, 300) and got[302] == (1, 300) and len(got) == 98


def test_op10_links_of_a_bucket_are_those_of_all_pairs(monkeypatch):
    """Rectangles of pairs that met earlier are passed over, all others compared, however small they are cut."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1, 8)) + 0.12 * rng.standard_normal((150, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    planes, sizes, ids = embedding_dedup.Planes(3, 4, 1), rng.integers(1, 5, 150), np.arange(1000, 1150)
    codes = planes.codes(x, 3)
    near = (x @ x.T >= 0.9) & ~np.eye(150, dtype=bool) & ~(codes[:, None] == codes[None]).any(axis=2)
    for products in (1, 500, 1 << 30):
        monkeypatch.setattr(embedding_dedup, "PRODUCTS", products)
        at, n, low = bucket_links(ids, sizes, x, 150, 3, planes, 0.9)
        want = near @ sizes
        assert at.tolist() == np.flatnonzero(want).tolist() and n.tolist() == want[want > 0].tolist() and (low <= ids[at]).all()
        cross = near.copy()
        cross[:60, :60] = cross[60:, 60:] = False
        at, n, _ = bucket_links(ids, sizes, x, 60, 3, planes, 0.9)
        assert n.tolist() == (cross @ sizes)[at].tolist() and set(at) == set(np.flatnonzero(cross @ sizes))
    monkeypatch.setattr(embedding_dedup, "PRODUCTS", 1)
    every = np.arange(150)
    pairs = [(a, b) for rows, columns in unmet(codes, every, every) for a in rows for b in columns]
    assert len(pairs) == len(set(pairs)) and {(a, b) for a, b in zip(*np.nonzero(near))} <= set(pairs)


def test_op1_parts_are_judged_in_linear_time():
    deep = "<div class=sidebar>" * 20_000 + f"<p>{P}</p>"
    blocks, parts = html_extraction.parse(deep)
    assert len(parts) == 20_001 and places(blocks, parts) == [0]

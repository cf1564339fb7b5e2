"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from touchline.plans import catalogue
from touchline.plans.catalogue import QUERIES
from touchline.plans.oracles import ORACLES
from touchline.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_storing_works_the_tracks_out_no_more_than_once_a_step(spark, monkeypatch):
    asked = []
    held = catalogue.adapt
    monkeypatch.setattr(catalogue, "adapt", lambda spark, sf_dir, name: asked.append(name) or held(spark, sf_dir, name))
    assert QUERIES["stored_events"](spark, SF).count() > 0
    assert asked.count("detected_events") == 1 and asked.count("team_frames") == 1 and asked.count("tracks") == 2


def test_best_crops_come_from_all_frames(spark, tmp_path):
    """Against plain loops; one track is seen once, in a frame that no stride of 3 meets."""
    seen = [(f, 0, float(f * 7 % 200)) for f in range(60)] + [(61, 1, 90.0)]
    spark.createDataFrame(seen, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    tracks = {}
    for f, user, sharp in seen:
        rear = f % 3 / 2
        quality = round(0.45 * min(1, (24 + f * 31 % 120) * (16 + f * 17 % 90) / 12000) + 0.35 * min(1, sharp / 180) + 0.2 * rear, 3)
        tracks.setdefault(user % 22 + 1, []).append((quality + 0.25 * rear, f, quality))
    want = [(k, n, f, q, round(s, 6)) for k, crops in tracks.items() for n, (s, f, q) in enumerate(sorted(crops, reverse=True)[:16], 1)]
    got = QUERIES["crops_topk"](spark, str(tmp_path)).select("track_id", "rank", "frame_num", "quality", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(f % 3 for _, _, f, *_ in want)

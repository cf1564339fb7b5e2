import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import tracker as tk
from touchline.sources import files
from touchline.streaming import replay, stateful
from touchline.streaming.replay import Replay

SCHEMA = tk.SCHEMA


def plain_tracks(rows):
    """Every match frame by frame, each overlap worked out alone and the greatest taken again and again."""
    out = []
    for match in sorted({r[0] for r in rows}):
        tracks, started = [], 0
        for frame in sorted({r[1] for r in rows if r[0] == match}):
            found = sorted((r for r in rows if r[:2] == (match, frame)), key=lambda r: (-r[7], *r[2:6], r[6]))
            tracks = [t for t in tracks if frame - t["seen"] <= tk.KEPT]
            recent, given = [t for t in tracks if frame - t["seen"] <= 1], {}

            def overlap(d, t):
                box = [x + v * (frame - t["seen"]) for x, v in zip(t["box"], t["v"])]
                w, h = min(d[4], box[2]) - max(d[2], box[0]), min(d[5], box[3]) - max(d[3], box[1])
                shared = max(w, 0) * max(h, 0)
                area = lambda b: max(b[2] - b[0], 0) * max(b[3] - b[1], 0)
                whole = area(d[2:6]) + area(box) - shared
                return shared / whole if whole > 0 else 0.0

            for some, least, pool in (([k for k, d in enumerate(found) if d[7] >= tk.SURE], tk.OVERLAP, tracks), ([k for k, d in enumerate(found) if tk.LEAST <= d[7] < tk.SURE], tk.OVERLAP_UNSURE, recent)):
                free = [t for t in pool if t["seen"] < frame]
                pairs = sorted(((-overlap(found[k], t), k, j) for k in some for j, t in enumerate(free)))
                used = set()
                for gain, k, j in pairs:
                    if -gain >= least and k not in given and j not in used:
                        t, box = free[j], found[k][2:6]
                        gap = frame - t["seen"]
                        t["v"] = [(1 - tk.STEP) * v + tk.STEP * (b - a) / gap for v, a, b in zip(t["v"], t["box"], box)]
                        t["box"], t["new"] = list(box), frame
                        given[k] = t["n"]
                        used.add(j)
                for t in tracks:
                    t["seen"] = t.pop("new", t["seen"])
            for k, d in enumerate(found):
                if k not in given and d[7] >= tk.STARTS:
                    started += 1
                    given[k] = started
                    tracks.append({"n": started, "box": list(d[2:6]), "v": [0.0] * 4, "seen": frame})
            out += [(*found[k], n) for k, n in given.items()]
    return sorted(out)


def players(seed, matches=3, frames=90):
    """Players that walk, cross, hide for a while and are seen with more or less confidence."""
    rng, rows = random.Random(seed), []
    for m in range(matches):
        walkers = [[rng.uniform(0, 900), rng.uniform(0, 500), rng.uniform(-6, 6), rng.uniform(-3, 3)] for _ in range(8)]
        for f in range(frames):
            for k, w in enumerate(walkers):
                w[0], w[1] = w[0] + w[2], w[1] + w[3]
                if rng.random() < 0.9 and not (k == 2 and 20 < f < 40) and not (k == 3 and 20 < f < 70):
                    rows.append((m, f, round(w[0], 3), round(w[1], 3), round(w[0] + 30, 3), round(w[1] + 70, 3), "player", round(rng.choice([0.05, 0.15, 0.2, 0.3, 0.9]), 2)))
    return [*rows, rows[5], rows[5]]


def tracked(df):
    return sorted((*[r[c] for c in tk.COLUMNS], r.track_id) for r in df.collect())


def test_tracks_are_those_of_plain_loops(spark):
    rows = players(1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_tracks(rows)
    for parts in (1, 7):
        assert tracked(tk.assign_tracks(df.repartition(parts))) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert tracked(tk.assign_tracks(df)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    longest = max(sum(r[-1] == n and r[0] == 0 for r in want) for n in range(1, 30))
    assert longest > 40 and tk.assign_tracks(df.limit(0)).count() == 0


def test_a_hidden_player_comes_back(spark):
    walk = lambda f: (0, f, 10.0 + 5 * f, 0.0, 40.0 + 5 * f, 70.0, "player", 0.9)
    rows = [walk(f) for f in [*range(20), *range(30, 40), *range(75, 80)]] + [(0, 3, None, 0.0, 1.0, 1.0, "player", 0.9)]
    got = tracked(tk.assign_tracks(spark.createDataFrame(rows, SCHEMA)))
    assert [r[-1] for r in got] == [1] * 30 + [2] * 5


def test_streamed_tracks_are_those_of_the_table(spark):
    rows = spark.createDataFrame(players(2, matches=2), SCHEMA)
    replay = Replay(rows)
    replay.play(5)
    first = replay.run(stateful.stream_tracks)
    replay.play()
    second = replay.run(stateful.stream_tracks)
    assert tracked(replay.result()) == tracked(tk.assign_tracks(rows))
    triggers = [p for q in (first, second) for p in q.recentProgress if p["numInputRows"]]
    assert len(triggers) >= 10 and len(first.recentProgress) >= 5
    told = replay.progress([first, second]).orderBy("trigger").collect()
    share = [r.percent for r in told]
    assert share == sorted(share) and share[-1] == 100 and sum(r.n_rows for r in told) == rows.count()


def test_few_bytes_of_many_matches_are_tracked_in_several_tasks(spark):
    parts = tk.assign_tracks(spark.createDataFrame(players(3, matches=12, frames=5), SCHEMA)).select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() > 1


def test_a_replay_works_its_rows_out_once_and_has_more_files_of_more_rows(spark, monkeypatch):
    monkeypatch.setattr(replay, "ROWS_A_FILE", 20)
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = spark.range(1200).selectExpr("id % 10 AS match_id", "id DIV 10 AS frame_num").mapInPandas(counted, "match_id long, frame_num long")
    played = replay.Replay(rows)
    assert (played.slots, played.files) == (12, 5)
    played.play()
    assert seen.value == 1200 and spark.read.parquet(f"{played.base}/in/*").count() == 1201
    assert len(spark.read.parquet(f"{played.base}/in/000003").inputFiles()) == 5


def test_overlaps_and_assignment():
    a = np.array([[0.0, 0, 2, 2], [5, 5, 5, 9]])
    assert tk.overlaps(a, np.array([[1.0, 0, 3, 2], [0, 0, 2, 2], [5, 5, 5, 9]])).tolist() == [[1 / 3, 1, 0], [0, 0, 0]]
    assert tk.assign(np.array([[0.5, 0.9], [0.9, 0.2]]), 0.3) == [(0, 1), (1, 0)] and tk.assign(np.array([[0.9, 0.8], [0.8, 0.1]]), 0.2) == [(0, 0)]


def tables(spark, version):
    plays = spark.createDataFrame([(10 * m + k, m, version) for m in (1, 2) for k in (0, 1)], "play_id long, match_id long, score long")
    return {"plays": plays, "events": spark.createDataFrame([(m, m, version) for m in (1, 2)], "event_id long, match_id long, v long"), "players": spark.createDataFrame([(version,)], "player_id long")}


@pytest.mark.parametrize("fails", [0, 1, 2, 3])
def test_a_failed_save_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch, fails):
    path = str(tmp_path / "s")
    assert files.read_store(spark, path) == {} and files.save_store(tables(spark, 1), path) == 1
    before = {k: sorted(map(tuple, v.collect())) for k, v in files.read_store(spark, path).items()}
    writer, done = type(spark.range(1).write), []

    def failing(kind):
        held = getattr(writer, kind)

        def write(self, *a, **k):
            if len(done) == fails:
                raise RuntimeError("lost")
            done.append(1)
            return held(self, *a, **k)

        return write

    with monkeypatch.context() as m:
        for kind in ("parquet", "json"):
            m.setattr(writer, kind, failing(kind))
        with pytest.raises(RuntimeError):
            files.save_store(tables(spark, 2), path)
    assert {k: sorted(map(tuple, v.collect())) for k, v in files.read_store(spark, path).items()} == before
    assert files.save_store({k: v.where("match_id = 2") if k != "players" else v for k, v in tables(spark, 3).items()}, path) == 2
    got = files.read_store(spark, path)
    assert sorted((r.match_id, r.score) for r in got["plays"].collect()) == [(1, 1), (1, 1), (2, 3), (2, 3)] and got["players"].first().player_id == 3


def test_matches_share_state_keys(spark):
    """Matches with numbers in a row are one key of the state; each still has its own pause, its own end, and all of its rows."""
    events = [(m, f, "goal", 0.9) for m in [*range(0, 40), 1000] for f in range(m % 7, 400 if m % 2 else 300, 13 + m % 5)]
    rows = spark.createDataFrame(events, "match_id long, frame_num long, event string, confidence double")
    played = replay.Replay(rows)
    played.play(4)
    first = played.run(stateful.stream_cooldown)
    played.play()
    second = played.run(stateful.stream_cooldown)
    states = [o["numRowsTotal"] for q in (first, second) for p in q.recentProgress for o in p["stateOperators"]]
    assert 4 <= max(states) <= 5 and states[-1] <= 1  # 40 matches of 16 a key, one far off, and the row that ends the input
    want, last = [], {}
    for m, f, event, confidence in sorted(events):
        if f - last.get(m, -100) >= 60:
            last[m] = f
            want.append((m, f, event, confidence))
    got = [tuple(r) for r in played.result().select("match_id", "frame_num", "event", "confidence").collect()]
    assert sorted(got) == want


def test_a_match_without_a_number_is_streamed(spark):
    rows = spark.createDataFrame([(None, f, "foul", 0.8) for f in (0, 30, 70)] + [(3, 5, "goal", 0.9)], "match_id long, frame_num long, event string, confidence double")
    played = replay.Replay(rows.withColumn("match_id", F.coalesce("match_id", F.lit(-40).cast("long"))))
    played.play()
    played.run(lambda df: stateful.stream_cooldown(df.withColumn("match_id", F.nullif("match_id", F.lit(-40).cast("long")))))
    got = spark.read.parquet(f"{played.base}/out").where("match_id is null or match_id > 0").select("match_id", "frame_num").collect()
    assert sorted((r.match_id or 0, r.frame_num) for r in got) == [(0, 0), (0, 70), (3, 5)]

import random

from touchline.streaming import match_loop as loop
from touchline.streaming.replay import Replay


def match_rows(spark, frames, matches=2, tracks=6, seed=1):
    rng, teams, crops, touches, events = random.Random(seed), [], [], [], []
    for m in range(matches):
        for f in range(frames):
            touches += [(m, f, rng.randrange(tracks))] if rng.random() < 0.7 else []
            crops += [(m, f, k, round(rng.random(), 3), round(rng.random(), 3)) for k in range(tracks) if rng.random() < 0.3]
            teams += [(m, f, k, rng.randrange(3)) for k in range(tracks) if rng.random() < 0.1]
            events += [(m, f, rng.choice(["goal", "foul"]))] if rng.random() < 0.1 else []
    make = lambda rows, schema: spark.createDataFrame(rows, f"match_id long, frame_num long, {schema}")
    return (teams, crops, touches, events), loop.loop_rows(make(teams, "track_id long, team_id int"), make(crops, "track_id long, score double, quality double"), make(touches, "track_id long"), make(events, "event string"))


def plain_goals(teams, crops, touches, events):
    """Every match from its first frame to its last, with all that was seen kept."""
    out = []
    for m in sorted({e[0] for e in events}):
        last = loop.START
        for _, f, event in sorted(e for e in events if e[0] == m):
            if f - last < loop.COOLDOWN:
                continue
            last = f
            if event != "goal":
                continue
            near = sorted(t[1:] for t in touches if t[0] == m and f - loop.LOOKBACK <= t[1] <= f)
            if not near:
                out.append((m, f, None, None, None, None, [], []))
                continue
            at, track = near[-1]
            few = near[-loop.RECENT :]
            known = sorted(t[1:] for t in teams if t[0] == m and t[2] == track and t[1] <= f and t[3])
            best = sorted(((s, g, q) for k, g, c, s, q in crops if k == m and c == track and g <= f), reverse=True)[: loop.CROPS_READ]
            out.append((m, f, track, at, round(sum(t == track for _, t in few) / len(few), 3), known[0][2] if known else 0, [b[1] for b in best], [b[2] for b in best]))
    return out


def run(spark, rows, triggers, parts):
    before = spark.conf.get(*loop.PROVIDER)
    spark.conf.set(*loop.PROVIDER)
    try:
        replay, queries = Replay(rows, triggers), []
        for n in parts:
            replay.play(n)
            queries.append(replay.run(loop.attributed_goals))
        return sorted(tuple(r) for r in replay.result().collect()), queries
    finally:
        spark.conf.set(loop.PROVIDER[0], before)


def test_the_loop_is_the_plain_one_and_its_state_is_bounded(spark):
    peaks = []
    for frames, triggers in ((300, 10), (600, 20)):
        seen, rows = match_rows(spark, frames)
        got, queries = run(spark, rows, triggers, (triggers // 3, triggers // 3, None))
        assert [tuple(x) for x in got] == plain_goals(*seen) and len(got) > 4
        told = [p for q in queries for p in q.recentProgress if p["numInputRows"]]
        assert len(told) >= 10
        peaks.append(max(p["stateOperators"][0]["numRowsTotal"] for p in told))
    assert peaks[1] < 1.3 * peaks[0]  # twice the match, no more state


def test_only_the_first_team_of_a_track_waits():
    team = lambda frame, track, k: (frame, loop.TEAM, track, k, None, None, None, frame * 40)
    touch = (5, loop.TOUCH, 1, None, None, None, None, 200)
    held = [team(9, 1, 2), team(4, 1, 1), touch, team(6, 1, 2), team(3, 2, 1), team(8, 3, 2)]
    assert loop.MatchLoop.first_teams(held, {2: 1}) == [team(4, 1, 1), team(8, 3, 2), touch]

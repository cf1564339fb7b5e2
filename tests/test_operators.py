import pytest
from pyspark.sql import functions as F

from touchline.functions import colour, geometry, text
from touchline.operators import events, identity, possession, store, tracking

REDS_BLUES = {1: (0.0, 0.0, 255.0), 2: (255.0, 0.0, 0.0)}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hex_colours(spark):
    df = spark.createDataFrame([("#12A0ff",), ("blue",), (" 12a0FF ",), (None,)], "v string")
    r, g, b = colour.hex_to_rgb(F.col("v"))
    assert [tuple(x) for x in df.select(r, g, b).collect()] == [(18, 160, 255), (None,) * 3, (18, 160, 255), (None,) * 3]
    assert one(spark, colour.rgb_to_hex(F.lit(18.9), F.lit(160), F.lit(255))) == "#12A0FF"


@pytest.mark.parametrize(
    ("bgr", "kits", "options", "team"),
    [((4, 3, 248), REDS_BLUES, {}, 1), ((0, 0, 250), {1: (0, 0, 255), 2: (0, 0, 245)}, {"margin": 10}, 0), ((128, 128, 128), REDS_BLUES, {"most": 25}, 0)],
)
def test_team_of_a_colour(spark, bgr, kits, options, team):
    df = spark.createDataFrame([tuple(map(float, bgr))], "b double, g double, r double")
    got = colour.match_team(df, {k: tuple(map(float, v)) for k, v in kits.items()}, **options).first()
    assert got.team_id == team and (team == 0 or got.confidence > 0.7)


OCR = "match_id long, track_id long, frame_num long, text string, confidence double, crop_quality double"


def fused(spark, kind, cases):
    df = spark.createDataFrame([(0, 1, f, t, c, q) for t, c, f, q in cases], OCR)
    return [(r.value, round(r.confidence, 3)) for r in identity.consensus(identity.readings(df, kind)).collect()]


def test_consensus(spark):
    a = [("7", 0.91, 10, 0.9), ("7", 0.86, 13, 0.8), ("9", 0.93, 11, 0.7), ("RONALDO", 0.94, 13, 0.8)]
    assert fused(spark, "number", a) == [(7, 0.886)]
    assert fused(spark, "name", a) == [(None, 0.94)]
    assert fused(spark, "name", [("MESSI", 0.88, 20, 0.9), ("MESSI", 0.82, 23, 0.8)]) == [("MESSI", 0.852)]
    tie = [("7", 0.88, 10, 1.0), ("7", 0.87, 11, 1.0), ("9", 0.87, 12, 1.0), ("9", 0.86, 13, 1.0)]
    assert fused(spark, "number", tie)[0][0] is None
    assert fused(spark, "number", [("7", 0.49, 1, 1.0)]) == []


def test_readings(spark):
    df = spark.createDataFrame([(t,) for t in ("00", "123", "7 10", "x7y", "LIVE MATCH", "AB", "o'neill-x", "A" * 24, "A" * 25, "home  messi 7")], "t string")
    got = [(r.t, r.n, r.m) for r in df.select("t", text.numbers(F.col("t")).alias("n"), text.name(F.col("t")).alias("m")).collect()]
    assert got == [
        ("00", [0], None), ("123", [], None), ("7 10", [7, 10], None), ("x7y", [7], "X Y"), ("LIVE MATCH", [], None), ("AB", [], None),
        ("o'neill-x", [], "O'NEILL-X"), ("A" * 24, [], "A" * 24), ("A" * 25, [], None), ("home  messi 7", [7], "HOME MESSI"),
    ]


def test_last_touch(spark):
    touches = spark.createDataFrame([(0, 80, 4), (0, 88, 7), (0, 91, 7), (0, 10, 4)], "match_id long, frame_num long, track_id long")
    goal = lambda f: spark.createDataFrame([(0, f)], "match_id long, goal_frame long")
    got = possession.last_touch(goal(100), touches, lookback=60).first()
    assert (got.track_id, got.last_touch_frame, got.possession_confidence) == (7, 91, 0.667)
    assert possession.last_touch(goal(100), touches.where("frame_num = 10"), lookback=20).count() == 0
    assert possession.last_touch(goal(91), touches, lookback=0).first().last_touch_frame == 91


def test_nearest_player_limits(spark):
    box = "match_id long, frame_num long, track_id long, x1 double, y1 double, x2 double, y2 double"
    ball = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 0.0, 0.0), (0, 2, 1, 0.0, 0.0, 0.0, 0.0)], box)
    tracks = spark.createDataFrame([(0, 1, 5, 70.0, 0.0, 90.0, 0.0), (0, 2, 9, 10.0, 0.0, 90.0, 0.0), (0, 2, 8, -90.0, 0.0, -10.0, 0.0)], box)
    assert rows(possession.nearest_player(tracks, ball), "frame_num", "track_id", "distance") == [(2, 8, 10.0)]


def test_cooldown(spark):
    frames = [(0, 0), (0, 59), (0, 60), (0, 61), (0, 119), (0, 120), (1, 5)]
    df = spark.createDataFrame([(m, f, "goal", 0.9) for m, f in frames], "match_id long, frame_num long, event string, confidence double")
    assert rows(events.with_cooldown(df), "match_id", "frame_num") == [(0, 0), (0, 60), (0, 120), (1, 5)]


def test_eligible(spark):
    d = [("goal", 0.5, 1), ("goal", 0.9, 2), ("foul", 0.7, 1), ("foul", 0.9, 2), ("card", 0.7, 3), ("card", 0.69, 1), ("none", 1.0, 1)]
    df = spark.createDataFrame([(0, f, e, c) for e, c, f in d], "match_id long, frame_num long, event string, confidence double")
    present = spark.createDataFrame([(0, 1, 2, True), (0, 2, 1, False)], "match_id long, frame_num long, players long, has_ball boolean")
    assert rows(events.eligible(df, present), "event", "frame_num") == [("card", 3), ("foul", 1), ("goal", 1)]


def test_interpolation(spark):
    frames = spark.createDataFrame([(m, f) for m in (0, 1) for f in range(6)], "match_id long, frame_num long")
    seen = spark.createDataFrame([(0, 1, 1.0), (0, 4, 4.0)], "match_id long, frame_num long, x1 double")
    got = tracking.interpolate(frames, seen, ["x1"]).orderBy("match_id", "frame_num").collect()
    assert [r.x1 for r in got] == [1, 1, 2, 3, 4, 4] + [None] * 6


def test_speed(spark):
    frames = spark.createDataFrame([(0, f) for f in range(11)], "match_id long, frame_num long")
    p = spark.createDataFrame([(0, 1, f, float(f), 0.0) for f in range(11)] + [(0, 2, 0, 0.0, 0.0), (0, 2, 4, 1.0, 0.0)], "match_id long, track_id long, frame_num long, x double, y double")
    got = tracking.speed_distance(p, frames).orderBy("frame_num").collect()
    assert [(r.frame_num, round(r.speed, 6), r.distance) for r in got] == [(f, 86.4, 5.0 if f < 5 else 10.0) for f in range(10)]


def test_pitch(spark):
    df = spark.createDataFrame([(110.0, 1035.0), (700.0, 600.0), (0.0, 0.0), (110.9, 1035.9)], "x double, y double")
    x, y = geometry.project(F.col("x"), F.col("y"))
    got = df.select(F.round(x, 4), F.round(y, 4), geometry.in_pitch(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got[:3]] == [(0.0, 68.0, True), (10.616, 46.3648, True), (None, None, False)] and got[3][2]


def test_sticky(spark):
    df = spark.createDataFrame([(0, 1, f, t, c) for f, t, c in [(0, 0, 0.1), (1, 2, 0.8), (2, 0, 0.2), (3, 1, 0.9)]], "match_id long, track_id long, frame_num long, team_id int, confidence double")
    got = identity.sticky(df).orderBy("frame_num").collect()
    assert [(r.team_id, r.confidence) for r in got] == [(0, 0.1), (2, 0.8), (2, 0.8), (2, 0.8)]


def test_texts(spark):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, text.goal_text(s("Team A"), F.lit(7), s(None))) == "GOAL — Team A — #7 scored"
    assert one(spark, text.goal_text(s("Team A"), F.lit(7), s("SMITH"))) == "GOAL — Team A — #7 SMITH scored"
    assert one(spark, text.goal_text(s("Team A"), F.lit(None).cast("int"), s("SMITH"))) == "GOAL — Team A — scorer number unavailable"
    assert one(spark, text.clock(F.lit(24 * 6000 + 23), 24.0)) == "100:00"
    assert one(spark, text.clock_rounded(F.lit(59.5))) == "1:00" and one(spark, text.clock_rounded(F.lit(-3.0))) == "0:00"
    assert [one(spark, text.is_video(s(v))) for v in ("a.MOV", "b.webm", None, "c")] == [True, False, True, False]


def test_crop_limits(spark):
    df = spark.createDataFrame([(-5.0, 0.0, 15.0, 39.9), (25.0, 15.0, 95.0, 145.0)], "x1 double, y1 double, x2 double, y2 double")
    named = geometry.player_crop(120, 160) | geometry.jersey_crop(120, 160)
    a, b = df.select(*[v.alias(k) for k, v in named.items()]).collect()
    assert not a.p_ok and (b.px1, b.py1, b.px2, b.py2, b.p_ok) == (25, 15, 95, 145, True)
    assert (b.jx1, b.jy1, b.jx2, b.jy2, b.j_ok) == (30, 25, 89, 102, True)


def test_quality_is_rounded_as_in_the_sql(spark):
    rows = [(82, 72, 11.88, 0.5), (84, 46, 13.68, 0.0), (121, 105, 102.6, 0.5), (142, 102, 37.8, 0.5)]
    df = spark.createDataFrame(rows, "h int, w int, s double, r double")
    got = df.select(geometry.crop_quality(*map(F.col, "hwsr")).alias("q")).collect()
    assert [x.q for x in got] == [0.344, 0.172, 0.75, 0.624]
    exact = spark.createDataFrame([(0.0625,), (0.1875,), (None,)], "x double").select(geometry.half_even(F.col("x"), 3).alias("y")).collect()
    assert [x.y for x in exact] == [0.062, 0.188, None]


def test_register_and_upsert(spark):
    users = spark.createDataFrame([("Ann", "a@x")], "username string, email string")
    wanted = spark.createDataFrame([(1, "ANN", "n@x"), (2, "bob", "A@X"), (3, "cy", "c@x"), (4, "CY", "d@x"), (5, "di", "c@X")], "request_id long, username string, email string")
    assert rows(store.registrable(users, wanted), "request_id") == [(3,)]
    teams = spark.createDataFrame([(1, "Reds", "#FF0000")], "team_id long, team_name string, color string")
    got = store.upsert_teams(teams, spark.createDataFrame([("REDS", ""), ("Blues", "#0000FF")], "team_name string, color string"))
    assert rows(got, "team_id", "team_name", "color") == [(1, "Reds", "#FF0000"), (2, "Blues", "#0000FF")]


def test_streams_keep_all_rows_of_many_files_in_no_order(spark):
    from touchline.plans.catalogue import Tables, streamed
    from touchline.streaming import stateful

    teams = [(m, f, k, (m + k) % 2 + 1 if f else 0) for m in [*range(200), 5000] for f in range(3) for k in range(3)]
    batch = spark.createDataFrame(teams, "match_id long, frame_num long, track_id long, team_id int").repartition(60, F.xxhash64("match_id", "frame_num", "track_id"))
    got = rows(streamed(Tables(spark, ""), batch, stateful.sticky_teams), "match_id", "track_id", "team_id", "since")
    assert got == sorted((m, k, team, f) for m, f, k, team in teams if f == 1)


BOX = "match_id long, frame_num long, track_id long, x1 double, y1 double, x2 double, y2 double"
TEAM = "match_id long, track_id long, frame_num long, team_id int, team_name string, team_confidence double"


def test_scorer_is_named_by_what_was_read_up_to_the_goal(spark):
    """Readings and teams after the goal do not count, nor do crops beyond the best eight."""
    goals = spark.createDataFrame([(0, 45, 7), (0, 90, 7)], "match_id long, goal_frame long, track_id long")
    crops = spark.createDataFrame([(0, 7, f, 0.9, 0.9) for f in (39, 42, 48, 51)], "match_id long, track_id long, frame_num long, score double, quality double")
    read = [(0, 7, 39, "7", 0.91, 0.1), (0, 7, 42, "7", 0.91, 0.1), (0, 7, 48, "9", 0.99, 0.1), (0, 7, 51, "9", 0.99, 0.1), (0, 7, 54, "9", 0.99, 0.1)]
    candidates = spark.createDataFrame(read, "match_id long, track_id long, frame_num long, text string, confidence double, crop_quality double")
    found = identity.readings_as_of(goals, candidates, tracking.crops_as_of(goals, crops))
    got = identity.consensus(identity.readings(found, "number"), by=["match_id", "goal_frame"])
    assert rows(got.withColumn("c", F.round("confidence", 3)), "goal_frame", "value", "c") == [(45, 7, 0.91), (90, None, 0.99)]
    many = spark.createDataFrame([(0, 7, f, f / 100, 0.5) for f in range(30)], crops.schema)
    assert sorted(r.crop_frame for r in tracking.crops_as_of(goals.where("goal_frame = 45"), many).collect()) == list(range(22, 30))


def test_team_at_the_time_of_the_touch(spark):
    seen = spark.createDataFrame([(0, 4, 1, 0, "", 0.0), (0, 4, 5, 2, "Blues", 0.9), (0, 4, 8, 1, "Reds", 0.8), (0, 6, 2, 0, "", 0.0)], TEAM)
    known = identity.first_known(seen)
    assert rows(known, "track_id", "since", "team_id", "team_name", "team_confidence") == [(4, 5, 2, "Blues", 0.9)]
    near = spark.createDataFrame([(0, f, t, 1.0) for f, t in ((3, 4), (5, 4), (9, 4), (9, 6), (9, -1))], "match_id long, frame_num long, track_id long, distance double")
    got = rows(possession.possession(near, known), "frame_num", "track_id", "team_id", "team_name")
    assert got == [(3, 4, 0, "unknown_team"), (5, 4, 2, "Blues"), (9, 4, 2, "Blues"), (9, 6, 0, "unknown_team")]


def test_end_to_end_goal(spark):
    touches = spark.createDataFrame([(0, 40, 7)], "match_id long, frame_num long, track_id long")
    goals = spark.createDataFrame([(0, 45), (0, 300)], "match_id long, goal_frame long")
    got = possession.last_touch(goals, touches, all_goals=True)
    named = identity.team_as_of(got, identity.first_known(spark.createDataFrame([(0, 7, 40, 1, "Team A", 0.86)], TEAM)), "goal_frame")
    assert rows(named.where("goal_frame = 45"), "track_id", "team_name", "possession_confidence") == [(7, "Team A", 1.0)]
    late = named.where("goal_frame = 300").first()
    assert (late.track_id, late.last_touch_frame, late.possession_confidence, late.team_name) == (None, None, None, "unknown_team")
    assert possession.last_touch(goals, touches).count() == 1 and possession.ring(touches.union(touches.withColumn("frame_num", F.lit(41))), 1).first().frame_num == 41


def test_camera_moves_by_match(spark):
    point = "match_id long, frame_num long, feature_idx long, x double, y double"
    old = spark.createDataFrame([(0, 1, 0, 10.0, 0.0), (0, 1, 1, 0.0, 0.0), (1, 1, 0, 0.0, 0.0), (1, 2, 0, 1.0, 1.0)], point)
    new = spark.createDataFrame([(0, 1, 0, 4.0, 0.0), (0, 1, 1, 0.0, 5.0), (1, 1, 0, 3.0, -9.0), (1, 2, 0, 1.0, 3.0)], point)
    move = tracking.camera_movement(tracking.pair_points(old, new))
    assert rows(move, "match_id", "frame_num", "dx", "dy") == [(0, 1, 6.0, 0.0), (1, 1, -3.0, 9.0), (1, 2, 0.0, 0.0)]
    assert rows(tracking.movement_labels(move.where("match_id = 0")), "x_text", "y_text") == [("Camera Movement X: 6.00", "Camera Movement Y: 0.00")]
    at = spark.createDataFrame([(0, 1, 5, 5), (1, 1, 5, 5), (2, 1, 5, 5)], "match_id long, frame_num long, px int, py int")
    assert rows(tracking.adjust_positions(at, move), "match_id", "ax", "ay") == [(0, -1.0, 5.0), (1, 8.0, -4.0), (2, 5.0, 5.0)]


def test_classes_and_frame_numbers(spark):
    d = [("goalkeeper", 1, 0.9), ("player", 2, 0.9), ("referee", 3, 0.9), ("ball", 4, 0.2), ("ball", 5, 0.1), ("ball", 6, 0.05), ("player", 7, 0.09)]
    df = spark.createDataFrame([(0, 1, k, c, s, float(k), 0.0, 0.0, 0.0) for c, k, s in d], "match_id long, frame_num long, det_order int, object_class string, confidence double, x1 double, y1 double, x2 double, y2 double")
    parts = tracking.split_classes(df, ["player", "ball"])
    assert {k: rows(v, "x1") for k, v in parts.items()} == {"players": [(1.0,), (2.0,)], "referees": [(3.0,)], "ball": [(5.0,)]}
    assert parts["ball"].first().track_id == 1 and tracking.remap_classes(df, ["ball"]).where("object_class = 'goalkeeper'").count() == 1
    assert rows(tracking.number_frames(spark.createDataFrame([(0, 30), (0, 10), (1, 5)], "match_id long, at long"), "at"), "match_id", "frame_num") == [(0, 0), (0, 1), (1, 0)]


@pytest.mark.parametrize(
    ("payload", "want"),
    [('[{"res":{"rec_texts":["7","A, \\"B\\" ]"],"rec_scores":[0.91,1.5]}}]', [("7", 0.91), ('A, "B" ]', 1.0)]), ('[[[1,2],["11",0.89]]]', [("11", 0.89)]),
     ('{"texts":["x"],"scores":[-1]}', [("x", 0.0)]), ('["9", 0.5]', [("9", 0.5)]), ('[[[[[1,2],[3,4]],["a",0.1]],[[[1,2]],["b",0.2]]]]', [("a", 0.1), ("b", 0.2)]),
     ('{"res":{"rec_texts":["q","r"],"rec_scores":[0.3]}}', [("q", 0.3)]), ("[]", []), ("null", []), ('[{"res":{"rec_texts":[],"rec_scores":[]}}]', []),
     ('[{"texts":["7","12"],"scores":[0.9]},{"texts":["10"],"scores":[0.8]}]', [("7", 0.9), ("10", 0.8)]), ('[{"texts":["7"],"scores":[0.9]},{},["MESSI",0.8]]', [("7", 0.9), ("MESSI", 0.8)]), ('[{"texts":["7"],"scores":[0.9]},["MESSI",0.8]]', [("MESSI", 0.8)]),
     ('{"a":{"b":[{"c":{"res":{"texts":["x"],"scores":[1]}}},4,["y",2]]},"d":[[1],["z",0.5]]}', [("x", 1.0), ("y", 1.0), ("z", 0.5)]), ('{"rec_texts":[],"texts":["t"],"scores":[0.2]}', [("t", 0.2)]),
     ('{"texts":["t",null,7,"n","w"],"scores":[0.2,0.3,0.4,NaN,"no"]}', [("t", 0.2), ("7", 0.4)]), ('{"res":[["r",0.1]]}', [("r", 0.1)]), ("[[", []), ("", []), (None, []), ("[" * 600 + '["q",0.5]' + "]" * 600, [("q", 0.5)]), ("[" * 100_000, [])],
)
def test_payload_shapes(spark, payload, want):
    got = spark.createDataFrame([(payload,)], "p string").select(text.payload_readings(F.col("p")).alias("r")).first().r
    assert [tuple(x) for x in got] == want


def test_snapshot(spark):
    crops = spark.createDataFrame([(0, 7, 0.9)], "match_id long, track_id long, quality double")
    known = identity.first_known(spark.createDataFrame([(0, 7, 1, 1, "Team A", 0.9)], TEAM))
    read = spark.createDataFrame([(0, 7, 3, "7 X"), (0, 7, 2, "NEO"), (0, 8, 1, "12")], "match_id long, track_id long, frame_num long, text string")
    one = spark.createDataFrame([(0, 7, 7, 0.9, 2)], "match_id long, track_id long, value int, confidence double, support long")
    got = {r.track_id: r for r in identity.snapshot(read, crops, known, one, one.limit(0).withColumn("value", F.lit("x"))).collect()}
    assert tuple(got[7])[1:] == (7, 1, "Team A", 0.9, 7, 0.9, None, None, 1, ["7 X"], ["NEO", "7 X"])
    assert tuple(got[8])[1:] == (8, 0, "unknown_team", 0.0, None, None, None, None, 0, ["12"], [])


def test_checks_and_settings(spark):
    from touchline.functions import checks
    from touchline.plans.config import Run

    s, n = lambda v: F.lit(v).cast("string"), lambda v: F.lit(v).cast("int")
    assert [one(spark, checks.registration(s(u), s(e), s(p))) for u, e, p in (("ab", "a@b.co", "123456"), ("a", "a@b.co", "123456"), ("ab", "a@b", "123456"), ("ab", "a@b.co", "x" * 129), (None, "a@b.co", "123456"))] == [None, "username", "email", "password", "username"]
    assert [one(spark, checks.team_names(s(a), s(b))) for a, b in (("A", "B"), ("A ", " a"), ("", "B"), ("A", "x" * 101))] == [None, "same name", "team_1_name", "team_2_name"]
    assert [one(spark, checks.team_setting(n(i), s(t), [n(0), n(c), n(255)])) for i, t, c in ((1, "A", 3), (3, "A", 3), (2, " ", 3), (2, "A", 256), (2, "A", None))] == [None, "no such team", "nameless team", "no such colour", "no such colour"]
    assert [one(spark, checks.upload(s("x"), F.lit(z), F.lit(ok))) for z, ok in ((1, True), (1, False), ((2 << 30) + 1, True))] == [202, 415, 413]
    run = Run.of(spark, "in", "out", [(" Reds ", "#12A0ff"), ("Blues", " 0000FF ")], cooldown=30)
    assert run.kits == {1: (255.0, 160.0, 18.0), 2: (255.0, 0.0, 0.0)} and run.names[1] == "Reds" and run.limits["cooldown"] == 30 and run.limits["fps"] == 24.0
    good = [("A", "#000000"), ("B", "#000000")]
    for teams, limits in (([("A", "blue"), good[1]], {}), ([good[0], ("a", "#000000")], {}), ([good[0], (" ", "#000000")], {}), ([good[0], ("B", None)], {}), (good[:1], {}), (good, {"reach": 0}), (good, {"reacj": 1})):
        with pytest.raises(ValueError):
            Run.of(spark, "in", "out", teams, **limits)
    with pytest.raises(ValueError):
        Run.of(spark, "", "out", good)


def test_store_of_a_match(spark, tmp_path):
    matches = spark.createDataFrame([(1, None, None), (2, None, 5)], "match_id long, match_date timestamp, user_id long")
    plays = spark.createDataFrame([(10, 1, 100), (11, 1, 101), (12, 2, 100)], "play_id long, match_id long, team_id long")
    teams = spark.createDataFrame([(100, "Reds", "#FF0000"), (101, "Blues", "#0000FF")], "team_id long, team_name string, primary_color string")
    players = spark.createDataFrame([(3, 100, 7, "")], "player_id long, team_id long, jersey_no int, name string")
    told = [(1, 48, "goal", 4, "Reds", 7, None), (1, 120, "goal", 4, "Reds", 7, "NEO"), (1, 200, "goal", 5, "Blues", 9, "TRI"), (1, 300, "foul", None, None, None, None), (1, 400, "goal", 6, "Greens", 1, "X")]
    detected = spark.createDataFrame(told, "match_id long, frame_num long, event string, track_id long, team_name string, jersey_number int, player_name string").withColumns({k: F.lit(0.9) for k in ("jersey_confidence", "name_confidence")})
    got = store.stored_match(matches, plays, teams, players, detected, 24.0)
    assert rows(got["plays"], "play_id", "score") == [(10, 2), (11, 1), (12, 0)]
    assert rows(got["players"], "player_id", "team_id", "jersey_no", "name") == [(3, 100, 7, "NEO"), (4, 101, 9, "TRI")]
    assert rows(got["events"], "event_id", "event_name", "description", "time_seconds")[3:] == [(1000300, "Foul", "FOUL detected", 12.5), (1000400, "Goal", "GOAL — Greens — #1 X scored", 400 / 24)]
    assert [tuple(r) for r in got["occurrences"].orderBy("event_id").select("event_id", "play_id", "player_id", "detected_team_name").collect()] == [
        (1000048, 10, 3, "Reds"), (1000120, 10, 3, "Reds"), (1000200, 11, 4, "Blues"), (1000300, None, None, "unknown_team"), (1000400, None, None, "Greens")]
    one, two = store.match_objects(got, teams).orderBy("match_id").collect()
    assert (len(one.events), len(one.play), [t.teamName for t in one.teams], [p.name for p in one.players], two.events, two.match.userId) == (5, 2, ["Reds", "Blues"], ["NEO", "TRI"], None, 5)
    import json

    result = json.loads(store.result_json(store.match_objects(got, teams)).where("match_id = 1").first().result)
    assert result["score_sheet"] == [{"team": "Reds", "score": 2}, {"team": "Blues", "score": 1}] and [e["eventType"] for e in result["events"]] == ["goal"] * 3 + ["foul", "goal"]
    assert len({r.job_id for r in store.with_job_ids(matches).collect()}) == 2
    from touchline.sources.files import read_store, save_store

    for _ in range(2):
        save_store(got, f"{tmp_path}/s")
    save_store({k: v.where("match_id = 2") if k == "matches" else v for k, v in got.items()}, f"{tmp_path}/s")
    assert {k: v.count() for k, v in read_store(spark, f"{tmp_path}/s").items()} == {"matches": 2, "plays": 3, "events": 5, "occurrences": 5, "players": 2}
    jobs = spark.createDataFrame([("a", "completed", "r"), ("b", "queued", None)], "job_id string, status string, result string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    assert [tuple(r) for r in store.job_results(wanted, jobs).orderBy("job_id").collect()] == [("a", 200, "r"), ("b", 409, None), ("c", 404, None)]
    assert store.job_status(jobs).columns == ["job_id", "status", "stage", "progress_percent", "team_candidates", "error"]


def test_register_and_login_rows(spark):
    users = spark.createDataFrame([(4, "Ann", "a@x")], "user_id long, username string, email string")
    wanted = spark.createDataFrame([(1, " ann ", "n@x"), (2, "bob", " B@X "), (3, "cy", "A@x")], "request_id long, username string, email string")
    fresh, log = store.register(users, wanted, F.lit("2020-01-01"))
    assert rows(fresh, "user_id", "username", "email") == [(5, "bob", "b@x")] and rows(log, "user_id", "action", "timestamp") == [(5, "register", "2020-01-01")]
    attempts = spark.createDataFrame([("A@X", True), ("a@x", False), ("z@x", True), ("a@x", None)], "email string, verified boolean")
    tried, log = store.login(users, attempts, F.lit("now"))
    assert sorted(r.status for r in tried.collect()) == [200, 401, 401, 401] and rows(log, "user_id", "action") == [(4, "login")]


def test_boundaries(spark):
    import numpy as np

    from touchline.operators import boundary, calibrate

    frames = spark.createDataFrame([(0, f, bytes([f])) for f in range(45)], "match_id long, frame_num long, image binary").coalesce(1)

    def model(images):
        assert len(images) <= 20
        return [[("ball", 0.5, x[0], 0, 1, 1), ("player", 0.05, 0, 0, 1, 1)] for x in images]

    found = boundary.detect(frames, model)
    assert rows(found, "frame_num", "det_order", "object_class", "x1") == [(f, 0, "ball", float(f)) for f in range(45)]

    def reader():
        def read(image):
            if image == b"x":
                raise RuntimeError("unreadable")
            return [("7", 1.5), ("A", 0.4)]

        return read

    def broken():
        raise RuntimeError("no engine")

    crops = spark.createDataFrame([(0, 1, 2, 0.9, b"a"), (0, 1, 3, 0.8, b"x")], "match_id long, track_id long, frame_num long, quality double, image binary")
    assert rows(boundary.read_crops(crops, reader), "frame_num", "text", "confidence", "crop_quality") == [(2, "7", 1.0, 0.9), (2, "A", 0.4, 0.9)]
    assert [tuple(r) for r in boundary.read_crops(crops, broken).orderBy("frame_num").select("frame_num", "text", "error").collect()] == [(2, None, "no engine"), (3, None, "no engine")]
    v = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>").select(boundary.fixed_width(F.col("v"), 2).alias("a"), boundary.fixed_width(F.col("v"), 5).alias("b")).first()
    assert (v.a, v.b) == ([1.0, 2.0], [1.0, 2.0, 3.0, 0.0, 0.0])
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (6, 9), dtype=np.uint8)
    want = np.array([[sum(float(grey[abs(y + a) if y + a < 6 else 4, abs(x + b) if x + b < 9 else 7]) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) - 4.0 * grey[y, x] for x in range(9)] for y in range(6)]).var()
    got = spark.createDataFrame([(grey.tobytes(),)], "i binary").select(calibrate.sharpness(F.col("i"), F.lit(6), F.lit(9)).alias("s")).first().s
    assert abs(got - want) < 1e-6


def test_event_scores_follow_the_recurrence(spark, tmp_path):
    import math

    import numpy as np

    from touchline.operators import calibrate

    rng = np.random.default_rng(4)
    weights = {"wx": rng.normal(size=(2, 4)), "wh": rng.normal(size=(1, 4)), "b": rng.normal(size=4), "wo": rng.normal(size=(1, 3)), "bo": rng.normal(size=3)}
    calibrate.save_weights(spark, weights, f"{tmp_path}/w")
    loaded = calibrate.load_weights(spark, f"{tmp_path}/w")
    steps = [[0.5, -1.0], [2.0, 0.25], [-0.75, 1.5]]
    h = c = 0.0
    sig = lambda z: 1 / (1 + math.exp(-z))
    for x in steps:
        i, f, g, o = (sum(x[k] * weights["wx"][k][j] for k in (0, 1)) + h * weights["wh"][0][j] + weights["b"][j] for j in range(4))
        c = sig(f) * c + sig(i) * math.tanh(g)
        h = sig(o) * math.tanh(c)
    logits = [h * weights["wo"][0][j] + weights["bo"][j] for j in range(3)]
    df = spark.createDataFrame([(steps,)], "s array<array<double>>")
    got = df.select(calibrate.event_scores(F.col("s"), loaded).alias("p"), calibrate.event_scores(F.col("s"), loaded, separate=True).alias("q")).first()
    whole = sum(map(math.exp, logits))
    assert got.p == pytest.approx([math.exp(z) / whole for z in logits]) and got.q == pytest.approx([sig(z) for z in logits])


def test_team_calibration(spark):
    from touchline.operators import calibrate

    samples = [(10.0, 20.0, 230.0), (12.0, 18.0, 225.0), (220.0, 40.0, 20.0), (225.0, 38.0, 22.0)]
    made = [(1, *c, 3200, k) for k, c in enumerate(samples)] + [(1, *samples[0], 9000, 9), (2, 1.0, 1.0, 1.0, 5, 0), (3, 1.0, 1.0, 1.0, 5, 0), (3, 1.0, 1.0, 1.0, 5, 1), (4, None, 1.0, 1.0, 5, 0), (None, 1.0, 1.0, 1.0, 5, 0)]
    df = spark.createDataFrame(made, "match_id long, b double, g double, r double, area int, sample_id int")
    got = calibrate.calibrate_teams(df).orderBy("match_id", "cluster_id").collect()
    assert [(r.match_id, r.color, r.label, r.sample_id, r.members, r.sample_image, r.reason) for r in got] == [
        (1, "#1527DE", "Team 1", 2, 2, "team_1.jpg", None), (1, "#E4130A", "Team 2", 9, 3, "team_2.jpg", None),
        (2, None, None, None, None, None, "too few samples"), (3, None, None, None, None, None, "one colour only"),
    ]
    assert [r.reason for r in calibrate.calibrate_teams(df, least=6).collect()] == ["too few samples"] * 3
    assert calibrate.calibrate_teams(df.limit(0)).count() == 0
    told = {r.match_id: r for r in calibrate.candidates_json(calibrate.calibrate_teams(df)).collect()}
    assert told[2].team_candidates is None and told[2].error == "too few samples" and told[1].error is None and "#E4130A" in told[1].team_candidates


def test_kit_clusters_are_those_of_plain_two_means(spark):
    """Centres of many matches at once against plain loops, match by match."""
    import numpy as np

    from touchline.operators import calibrate

    rng = np.random.default_rng(2)
    made = [(m, *map(float, np.clip(np.rint(rng.normal((60, 90, 200) if rng.random() < 0.3 + m / 20 else (180, 100, 40), 25)), 0, 255))) for m in range(8) for _ in range(60)]
    got = {r.match_id: r for r in calibrate.kit_clusters(spark.createDataFrame(made, "match_id long, b double, g double, r double")).collect()}
    for m in range(8):
        x = np.array([c for k, *c in made if k == m])
        far = lambda o: max(map(tuple, x), key=lambda c: (((np.array(c) - o) ** 2).sum(), *(-np.array(c))))  # noqa: B023, E731
        first = np.array(far(x.mean(axis=0)))
        centers = [first, np.array(far(first))]
        for _ in range(calibrate.STEPS):
            second = ((x - centers[1]) ** 2).sum(axis=1) < ((x - centers[0]) ** 2).sum(axis=1)
            centers = [x[~second].mean(axis=0), x[second].mean(axis=0)]
        r = got[m]
        assert np.allclose([[r.b0, r.g0, r.r0], [r.b1, r.g1, r.r1]], centers) and r.n_samples == 60


def one_after_another(users, wanted):
    names, emails = {u.lower() for u, _ in users}, {e.lower() for _, e in users}
    got = []
    for i, u, e in sorted(set(wanted)):
        if u.lower() not in names and e.lower() not in emails:
            got.append((i,))
            names.add(u.lower())
            emails.add(e.lower())
    return got


@pytest.mark.parametrize("alone", [0, 25, 20_000])
def test_registration_of_chains(spark, alone):
    """Requests that were refused strike no others off, however long the chain; the result is that of one after another."""
    import random

    rng = random.Random(alone)
    chain = [(f"u{k // 2}", f"e{(k + 1) // 2}@x") for k in range(1000)]  # each shares its name with the next, or its email
    ids = rng.sample(range(1, 5000), 1000)
    wanted = [(i, u.upper() if i % 2 else u, e) for i, (u, e) in zip(ids, chain)]
    wanted += [(6000 + k, f"n{rng.randrange(60)}", f"m{rng.randrange(60)}@X") for k in range(200)] + [(6300, "hot", f"h{k}@x") for k in range(1)]
    wanted += [(6400 + k, "HOT", f"h{k}@x") for k in range(100)] + [wanted[0], (7000, "taken", "free@x"), (7001, "free", "Taken@x"), (7002, "free", "free@x")]
    users = [("Taken", "taken@X")]
    schema = "request_id long, username string, email string"
    got = store.registrable(spark.createDataFrame(users, "username string, email string"), spark.createDataFrame(wanted, schema), alone=alone)
    assert rows(got, "request_id") == one_after_another(users, wanted)
    three = [(0, "u0", "e1"), (1, "u1", "e1"), (2, "u1", "e2")]
    assert rows(store.registrable(spark.createDataFrame(users, "username string, email string"), spark.createDataFrame(three, schema), alone=alone), "request_id") == [(0,), (2,)]
    assert store.registrable(spark.createDataFrame(users, "username string, email string"), spark.createDataFrame([], schema), alone=alone).count() == 0


def test_streams_with_late_rows_and_without_state_at_the_end(spark, tmp_path):
    """Rows out of order within the delay count in their place, older ones are dropped; finished matches leave no state."""
    from touchline.streaming import stateful

    schema = "match_id long, frame_num long, event string, confidence double"
    batches = [[(0, 100), (0, 200)], [(0, 150), (0, 260)], [(0, 900)], [(0, 30), (0, 905)], [(0, 500), (1, 10)], [(2, 10)], [(9, 0)], [(9, 1)]]
    for k, batch in enumerate(batches):
        df = stateful.with_time(spark.createDataFrame([(m, f, "goal", 0.9) for m, f in batch], schema))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stateful.stream_cooldown(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "match_id", "frame_num")
    assert got == [(0, 30), (0, 100), (0, 200), (0, 260), (0, 900), (1, 10), (2, 10)]
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1] <= 2

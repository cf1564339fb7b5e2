"""The query catalogue: each query applies operators to the match tables in a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import checks, colour, text
from touchline.functions import geometry as geo
from touchline.operators import boundary, calibrate
from touchline.operators import events as ev
from touchline.operators import identity as idn
from touchline.operators import possession as pos
from touchline.operators import store
from touchline.operators import tracking as tr
from touchline.operators.team_names import resolve_names
from touchline.operators.tracker import assign_tracks
from touchline.plans.payloads import PAYLOADS
from touchline.sources import files
from touchline.sources.tables import adapt, read, shared_folder, staged
from touchline.streaming import match_loop as loop
from touchline.streaming import stateful as st
from touchline.streaming.replay import Replay

KITS = {1: (70.0, 70.0, 180.0), 2: (180.0, 70.0, 70.0)}
FRAME = (1920, 1080)
FPS = 24.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Tables:
    """The match tables of a folder, and what queries derive from them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return adapt(self.spark, self.sf_dir, name)

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def known_teams(self) -> DataFrame:
        """Since when each track's team is known, with its name; a team's id within a match is its slot."""
        names = self.plays.join(self.teams, "team_id").select("match_id", F.col("team_slot").alias("team_id"), "team_name")
        return idn.first_known(self.team_frames).join(names, ["match_id", "team_id"], "left")

    def touches(self) -> DataFrame:
        return pos.possession(pos.nearest_player(self.tracks, self.ball), self.known_teams())

    def touchers(self) -> DataFrame:
        """Touches without teams, for what asks only who touched the ball."""
        return pos.nearest_player(self.tracks, self.ball).where("track_id >= 0")

    def confirmed(self) -> DataFrame:
        return ev.with_cooldown(ev.eligible(self.detected_events, ev.presence(self.tracks, self.ball)))

    def goals(self, confirmed: DataFrame | None = None) -> DataFrame:
        """confirmed: the confirmed events, where they are at hand."""
        return (self.confirmed() if confirmed is None else confirmed).where("event = 'goal'").select("match_id", F.col("frame_num").alias("goal_frame"))

    def scorers(self) -> DataFrame:
        return pos.last_touch(self.goals(), self.touchers())

    def kits(self) -> DataFrame:
        return colour.match_team(self.player_colors, KITS).drop("b", "g", "r")

    def shirt(self, kind: str) -> DataFrame:
        return idn.consensus(idn.readings(self.ocr_candidates, kind))

    def placed_goals(self, confirmed: DataFrame | None = None) -> DataFrame:
        """All goals with the scorer, where there is one, and the scorer's team as of the goal."""
        rows = pos.last_touch(self.goals(confirmed), self.touchers(), all_goals=True)
        return idn.team_as_of(rows, self.known_teams(), "goal_frame")

    def named_scorers(self, confirmed: DataFrame | None = None) -> DataFrame:
        """All goals with the scorer's team, number and name as of the goal; without a touch they keep nulls."""
        goals = staged(self.placed_goals(confirmed))
        best = tr.crops_as_of(goals.where("track_id is not null").select("match_id", "goal_frame", "track_id"), tr.scored_crops(self.crops))
        return self.with_readings(goals, best)

    def with_readings(self, goals: DataFrame, best: DataFrame) -> DataFrame:
        """Goals with number and name by consensus of what was read from these crops."""
        read = idn.readings_as_of(goals, self.ocr_candidates, best)
        key = ["match_id", "goal_frame"]
        for kind, value, sure in (("number", "jersey_number", "jersey_confidence"), ("name", "player_name", "name_confidence")):
            found = idn.consensus(idn.readings(read, kind), by=key)
            goals = goals.join(found.select(*key, F.col("value").alias(value), F.col("confidence").alias(sure)), key, "left")
        return goals

    def stored(self) -> dict[str, DataFrame]:
        """What storing all matches adds to the store."""
        plays = self.plays.withColumn("play_id", F.col("match_id") * 2 + F.col("team_slot"))
        confirmed = staged(self.confirmed())
        scorers = self.named_scorers(confirmed).withColumnRenamed("goal_frame", "frame_num").drop("team_id")
        detected = confirmed.drop("confidence").join(scorers.withColumn("event", F.lit("goal")), ["match_id", "frame_num", "event"], "left")
        return store.stored_match(self.matches(), plays, self.teams, self.players(), staged(detected), FPS)

    def players(self) -> DataFrame:
        s = self.read("supplier").where("s_acctbal > 4500")
        return s.groupBy(F.col("s_nationkey").cast("long").alias("team_id"), (F.col("s_suppkey") % 100).cast("int").alias("jersey_no")).agg(
            F.min("s_suppkey").alias("player_id"), F.min(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("")).alias("name"))

    def jobs(self) -> DataFrame:
        done = F.col("status") == "completed"
        return self.matches().select(
            F.concat(F.lit("job-"), F.col("match_id").cast("string")).alias("job_id"), "status",
            F.when(done, F.lit("Analysis complete")).otherwise(F.lit("Analysis failed")).alias("stage"), F.when(done, 100).alias("progress_percent"),
            F.when(~done, F.lit("no ball")).alias("error"), F.when(done, F.col("match_id")).alias("result"),
        )

    def pitch_positions(self) -> DataFrame:
        x, y = geo.project(F.col("ax"), F.col("ay"))
        return self.adjusted().select("match_id", "track_id", "frame_num", x.alias("x"), y.alias("y"))

    def adjusted(self) -> DataFrame:
        px, py = geo.foot()
        rows = self.tracks.select("match_id", "track_id", "frame_num", px.alias("px"), py.alias("py"))
        return tr.adjust_positions(rows, self.movement())

    def movement(self) -> DataFrame:
        return tr.camera_movement(tr.pair_points(self.old_points, self.new_points))

    def occurrences(self) -> DataFrame:
        """Two records for some goals: the later one counts."""
        s = self.named_scorers().withColumn("event_id", F.col("match_id") * 1000 + F.col("goal_frame"))
        one = s.select("event_id", (F.col("event_id") * 2).alias("occurrence_id"), F.col("track_id").alias("detected_track_id"), F.col("jersey_number").alias("detected_jersey_no"))
        two = one.where("event_id % 3 = 0").select("event_id", (F.col("occurrence_id") + 1).alias("occurrence_id"), (F.col("detected_track_id") + 100).alias("detected_track_id"), "detected_jersey_no")
        return one.unionByName(two)

    def matches(self) -> DataFrame:
        o = self.read("orders").withColumn("match_id", F.floor(F.col("o_orderkey") / 1000).cast("long"))
        return o.groupBy("match_id").agg(F.max("o_orderdate").alias("match_date"), (F.min("o_custkey") % 5).alias("user_id"), F.count_if(F.col("o_orderstatus") == "P").alias("open")).select(
            "match_id", "match_date", "user_id", F.when(F.col("open") > 0, "completed").otherwise("failed").alias("status")
        )


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


@query
def bbox_center_foot(t):
    rows = t.tracks.withColumn("object_class", F.lit("player")).unionByName(t.ball.withColumns({"track_id": F.lit(1).cast("long"), "object_class": F.lit("ball")}))
    (cx, cy), (fx, fy), (px, py) = geo.center(), geo.foot(), geo.position(F.col("object_class"))
    named = {"cx": cx, "cy": cy, "fx": fx, "fy": fy, "px": px, "py": py, "width": F.col("x2") - F.col("x1")}
    return rows.select("match_id", "frame_num", "object_class", "track_id", *[v.alias(k) for k, v in named.items()])


@query
def pair_distance(t):
    bx, by = geo.center()
    at = t.ball.select("match_id", "frame_num", bx.alias("bx"), by.alias("by"))
    fx, fy = geo.foot()
    rows = t.tracks.select("match_id", "frame_num", "track_id", fx.alias("fx"), fy.alias("fy")).join(at, ["match_id", "frame_num"])
    far = geo.distance(F.col("fx"), F.col("fy"), F.col("bx"), F.col("by"))
    return rows.select("match_id", "frame_num", "track_id", far.alias("distance"), (F.col("fx") - F.col("bx")).alias("dx"), (F.col("fy") - F.col("by")).alias("dy"))


@query
def class_remap_split(t):
    rows = tr.remap_classes(t.detections, ["player", "goalkeeper", "referee", "ball"])
    return rows.select("match_id", "frame_num", "track_id", "object_class", "confidence")


@query
def ball_last_detection(t):
    return tr.last_ball(t.ball_detections)


@query
def class_split(t):
    """Players, referees and the ball of the detections, as one table."""
    balls = t.ball_detections.withColumns({"track_id": F.col("det_order"), "object_class": F.lit("ball")})
    rows = t.detections.withColumn("det_order", F.col("track_id")).unionByName(balls)
    parts = tr.split_classes(rows, ["player", "goalkeeper", "referee", "ball"])
    one = [d.select(F.lit(k).alias("part"), "match_id", "frame_num", F.col("track_id").cast("long"), "x1", "y2") for k, d in parts.items()]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query
def camera_movement_argmax(t):
    return t.movement()


@query
def flow_features(t):
    return tr.flow_features(t.movement())


@query
def staged_tracks(t):
    """Tracks read back from where they were staged, as a run does that finds them there."""
    return staged(t.tracks).groupBy("match_id", "track_id").agg(F.count("*").alias("n_rows"), F.min("frame_num").alias("first_frame"), F.max("x2").alias("right"))


@query
def movement_labels(t):
    return tr.movement_labels(t.movement().withColumns({k: F.round(k, 2) for k in ("dx", "dy")}))


@query
def frame_numbers(t):
    """Frames numbered by the time of the orders behind them."""
    o = t.read("orders").select(F.floor(F.col("o_orderkey") / 1000).cast("long").alias("match_id"), "o_orderkey")
    return tr.number_frames(o.withColumn("at", F.col("o_orderkey")), "at")


@query
def camera_adjust(t):
    return t.adjusted()


@query
def point_in_pitch(t):
    return t.adjusted().select("match_id", "track_id", "frame_num", geo.in_pitch(F.col("ax"), F.col("ay")).alias("inside"))


@query
def homography_project(t):
    return t.pitch_positions().select("match_id", "track_id", "frame_num", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def crop_boxes(t):
    named = geo.player_crop(*FRAME) | geo.colour_crop(*FRAME) | geo.jersey_crop(*FRAME)
    return t.tracks.select("match_id", "frame_num", "track_id", *[v.cast("int").alias(k) if not k.endswith("ok") else v.alias(k) for k, v in named.items()])


@query
def crop_quality(t):
    return tr.scored_crops(t.crops, 1).select("match_id", "frame_num", "track_id", "quality", F.round("score", 6).alias("score"))


@query
def crops_topk(t):
    return tr.top_crops(tr.scored_crops(t.crops, 1)).select("match_id", "track_id", "rank", "frame_num", "quality", F.round("score", 6).alias("score"))


@query
def crops_as_of_goal(t):
    goals = t.scorers().select("match_id", "goal_frame", "track_id")
    rows = tr.crops_as_of(goals, tr.scored_crops(t.crops))
    return rows.select("match_id", "goal_frame", "track_id", "rank", "crop_frame", "quality")


@query
def scorer_image_path(t):
    goals = t.scorers().select("match_id", "goal_frame", "track_id")
    top = tr.crops_as_of(goals, tr.scored_crops(t.crops), keep=1)
    name = F.concat(F.lit("track_"), F.col("track_id").cast("string"), F.lit("_frame_"), F.col("crop_frame").cast("string"), F.lit(".jpg"))
    return top.select("match_id", "goal_frame", text.join_url(F.lit("/media/scorers//"), name).alias("url"))


@query
def hex_rgb_roundtrip(t):
    p = t.read("part").withColumn("value", F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(
        F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("#")).otherwise(F.lit("")), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))))
    r, g, b = colour.hex_to_rgb(F.col("value"))
    rows = p.select("p_partkey", "value", r.alias("r"), g.alias("g"), b.alias("b"))
    return rows.withColumn("back", colour.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))


@query
def bgr_to_lab(t):
    rows = colour.with_lab(t.player_colors)
    return rows.select("match_id", "track_id", "frame_num", *[F.round(k, 4).alias(k) for k in ("l", "a", "lab_b")])


@query
def color_match_team(t):
    return t.kits()


@query
def team_sticky(t):
    return idn.sticky(t.kits().select("match_id", "track_id", "frame_num", "team_id", "confidence"))


@query
def nearest_player(t):
    return pos.nearest_player(t.tracks, t.ball)


@query
def possession(t):
    return t.touches()


@query
def ball_control_pct(t):
    rows = pos.ball_control(t.frames, t.touches())
    return rows.withColumns({k: F.round(k, 6) for k in ("team_1_share", "team_2_share")})


@query
def ball_interpolate(t):
    cols = ["x1", "y1", "x2", "y2"]
    return tr.interpolate(t.frames, t.ball, cols).withColumns({c: F.round(c, 6) for c in cols})


@query
def speed_distance(t):
    rows = tr.speed_distance(t.pitch_positions(), t.frames)
    return rows.withColumns({"speed": F.round("speed", 6), "distance": F.round("distance", 6)})


@query
def speed_labels(t):
    rows = tr.speed_distance(t.pitch_positions(), t.frames).join(t.tracks, ["match_id", "track_id", "frame_num"])
    fx, fy = geo.foot()
    shown = lambda v, unit: F.concat(F.format_string("%.2f", F.round(v, 2)), F.lit(unit))
    return rows.select("match_id", "track_id", "frame_num", fx.alias("label_x"), (fy + 40).alias("speed_y"), (fy + 60).alias("distance_y"), shown("speed", " km/h").alias("speed_text"), shown("distance", " m").alias("distance_text"))


@query
def annotations(t):
    return tr.annotations(t.tracks)


@query
def feature_window(t):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    rows = tr.feature_windows(t.features)
    return rows.select("match_id", "frame_num", F.size("sequence").alias("steps"), F.round(total(F.col("sequence")[0]), 4).alias("first_sum"), F.round(total(F.col("sequence")[9]), 4).alias("last_sum"))


@query
def feature_fixed(t):
    """Vectors of 64 values cut to 40 and filled up to 80."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    cut, filled = (boundary.fixed_width(F.col("embedding"), n) for n in (40, 80))
    return t.features.select("match_id", "frame_num", *[F.size(v).alias(f"n_{k}") for k, v in (("cut", cut), ("filled", filled))], F.round(total(cut), 4).alias("cut_sum"), F.round(total(filled), 4).alias("filled_sum"))


@query
def event_types(t):
    return ev.accepted(t.detected_events)


@query
def event_thresholds(t):
    return ev.eligible(t.detected_events, ev.presence(t.tracks, t.ball))


@query
def event_presence(t):
    return ev.presence(t.tracks, t.ball)


@query
def event_cooldown(t):
    return t.confirmed()


@query
def event_cooldown_per_class(t):
    return ev.with_cooldown(ev.peaks(t.detected_events, {"goal": 0.25, "card": 0.30, "foul": 0.55}), 20, ("match_id", "event"))


@query
def event_peak(t):
    return ev.peaks(t.detected_events, {"goal": 0.25, "card": 0.30, "foul": 0.55})


@query
def scorer_last_touch(t):
    return t.scorers().select("match_id", "goal_frame", "track_id", "last_touch_frame")


@query
def possession_confidence(t):
    return t.scorers().select("match_id", "goal_frame", "possession_confidence")


@query
def ocr_numbers(t):
    c = t.ocr_candidates
    return c.select("match_id", "frame_num", "track_id", "text", F.explode(text.numbers(F.col("text"))).alias("number"))


@query
def ocr_names(t):
    return t.ocr_candidates.select("match_id", "frame_num", "track_id", "text", text.name(F.col("text")).alias("name")).where("name is not null")


@query
def jersey_consensus(t):
    return t.shirt("number")


@query
def name_consensus(t):
    return t.shirt("name")


@query
def ocr_payload_flatten(t):
    """Payloads of all shapes, by frame, to rows."""
    text_of = F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    one, two = (F.round(c, 2).cast("string") for c in ("confidence", "crop_quality"))
    shape = F.get(F.array(*map(F.lit, PAYLOADS)), (F.col("frame_num") % len(PAYLOADS)).cast("int"))
    payload = F.replace(F.replace(F.replace(shape, F.lit("{t}"), text_of), F.lit("{a}"), one), F.lit("{b}"), two)
    rows = t.ocr_candidates.select("match_id", "frame_num", F.posexplode(text.payload_readings(payload)).alias("item", "z"))
    return rows.select("match_id", "frame_num", "item", "z.text", "z.score")


@query
def text_kinds(t):
    c = F.col("text")
    return t.ocr_candidates.select("match_id", "frame_num", "track_id", "text", text.has_digit(c).alias("digit"), text.has_letter(c).alias("letter"))


@query
def goal_text(t):
    shown = text.goal_text(F.col("team_name"), F.col("jersey_number"), F.col("player_name"))
    return t.named_scorers().select("match_id", "goal_frame", shown.alias("description"))


@query
def match_summary_text(t):
    goals = t.named_scorers().select("match_id", F.col("goal_frame").alias("frame_num"), text.goal_text(F.col("team_name"), F.col("jersey_number"), F.col("player_name")).alias("g"))
    rows = t.confirmed().join(goals, ["match_id", "frame_num"], "left")
    line = F.concat(text.clock(F.col("frame_num"), FPS), F.lit(" → "), F.when(F.col("event") == "goal", F.col("g")).otherwise(F.upper("event")))
    return rows.select("match_id", "frame_num", line.alias("line"), store.event_description(F.col("event"), F.col("g")).alias("description"), F.initcap("event").alias("event_name"))


@query
def time_mmss(t):
    f = t.frames
    return f.select("match_id", "frame_num", (F.col("frame_num") / FPS).alias("seconds"), text.clock(F.col("frame_num"), FPS).alias("clock"))


@query
def time_mss_rounded(t):
    return t.frames.select("match_id", "frame_num", text.clock_rounded((F.col("frame_num") - 24) / FPS).alias("clock"))


@query
def score_sheet(t):
    goals = t.placed_goals().select("match_id", "goal_frame", F.col("team_id").alias("team_slot"))
    return ev.score_sheet(t.plays, goals).join(t.teams, "team_id").select("match_id", "team_slot", "team_name", "score")


SCORER = ["match_id", "goal_frame", "track_id", "team_name", "jersey_number", "jersey_confidence", "player_name", "name_confidence", "possession_confidence"]


@query
def scorer_list(t):
    return t.named_scorers().select(*SCORER)


@query
def scorers_shown(t):
    """The scorers as a page shows them, with what stands for a missing number or name."""
    number, name = text.shown(F.col("jersey_number")), text.shown(F.col("player_name"), "Name not confirmed")
    return t.named_scorers().select("match_id", "goal_frame", number.alias("number"), name.alias("name"))


@query
def possession_ring(t):
    return pos.ring(t.touches()).select("match_id", "frame_num", "track_id")


@query
def stored_plays(t):
    return t.stored()["plays"].select("play_id", "match_id", "team_id", "score")


@query
def stored_events(t):
    return t.stored()["events"].withColumn("time_seconds", F.round("time_seconds", 6))


@query
def stored_occurrences(t):
    return t.stored()["occurrences"].drop("start_time", "end_time", "jersey_confidence", "name_confidence")


@query
def stored_players(t):
    return t.stored()["players"]


@query
def match_object(t):
    """What the object of a match holds: how many entities of each kind, its teams, its goals, and what its events say."""
    o = store.match_objects(t.stored(), t.teams.withColumn("primary_color", F.lit("#000000")))
    told = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "|"), F.lit(""))
    sizes = [F.greatest(F.coalesce(F.size(k), F.lit(0)), F.lit(0)).alias(f"n_{k.lower()}") for k in ("teams", "play", "events", "occurBy", "players")]
    score = F.coalesce(F.aggregate("play", F.lit(0).cast("long"), lambda s, x: s + x["score"]), F.lit(0))
    return o.select("match_id", *sizes, told("teams", lambda x: x["teamName"]).alias("team_names"), score.alias("goals"), told("events", lambda x: x["description"]).alias("descriptions"))


@query
def sample_frames(t):
    return tr.sample_frames(t.frames)


@query
def match_list(t):
    return store.match_list(t.matches())


@query
def match_list_of_user(t):
    return store.match_list(t.matches(), 1)


@query
def match_summary(t):
    return store.match_summary(t.matches(), t.plays, t.confirmed(), t.teams)


@query
def occurrence_lookup(t):
    e = t.confirmed().withColumn("event_id", F.col("match_id") * 1000 + F.col("frame_num")).select("event_id", "match_id", "event")
    return store.event_entries(e, t.occurrences())


@query
def team_upsert(t):
    teams = t.teams.withColumn("color", F.lit("#000000"))
    wanted = t.read("supplier").select(
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("Club "), F.col("s_nationkey").cast("string"))).otherwise(F.lit("germany")).alias("team_name"),
        F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("#"), F.lpad((F.col("s_nationkey") * 1000 + F.col("s_suppkey") * 7 % 1000).cast("string"), 6, "0"))).alias("color"),
        F.col("s_suppkey").alias("order"),
    )
    return store.upsert_teams(teams, wanted)


@query
def player_upsert(t):
    s = t.read("supplier")
    seen = s.select(F.col("s_nationkey").cast("long").alias("team_id"), (F.col("s_suppkey") % 100).cast("int").alias("jersey_no"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("event_id"))
    return store.upsert_players(t.players(), seen)


@query
def register_dedupe(t):
    """All rounds on the cluster, down to the last undecided request."""
    return store.registrable(*people(t), alone=0)


def people(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers with a good balance as users, and all of them as requests."""
    c = t.read("customer")
    person = lambda n: [n.alias("username"), F.concat(F.lit("mail"), (F.col("c_custkey") % 997).cast("string"), F.lit("@example.com")).alias("email")]
    users = c.where("c_acctbal > 4500").select(F.col("c_custkey").alias("user_id"), *person(F.lower("c_name")))
    # two of three requests share their name, in other letters, and those far apart their email: chains of conflicts
    name = F.when(F.col("c_custkey") % 3 == 1, F.upper("c_name")).otherwise(F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") - F.col("c_custkey") % 3 + 2).cast("string"), 9, "0")))
    return users, c.select(F.col("c_custkey").alias("request_id"), *person(name))


@query
def register_rows(t):
    """New users with their log rows."""
    fresh, log = store.register(*people(t), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    return fresh.join(log, "user_id")


@query
def login_status(t):
    users, wanted = people(t)
    attempts = wanted.select("request_id", F.upper("email").alias("email"), (F.col("request_id") % 3 > 0).alias("verified"))
    first = users.groupBy("email").agg(F.min("user_id").alias("user_id"))
    return store.login(first, attempts, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))[0].select("request_id", "user_id", "status")


@query
def registration_check(t):
    """Which requests would be refused, and why: names, emails and passwords of several kinds."""
    c, k = t.read("customer"), F.col("c_custkey")
    name = F.when(k % 5 == 0, F.substring("c_name", 1, 1)).otherwise(F.col("c_name"))
    email = F.when(k % 7 == 0, F.col("c_name")).otherwise(F.concat(F.col("c_name"), F.lit("@example.com")))
    password = F.repeat(F.lit("x"), (k % 140).cast("int"))
    return c.select("c_custkey", checks.registration(name, F.regexp_replace(email, "[ #]", "."), password).alias("reason"))


@query
def team_names_check(t):
    n, r = t.read("nation"), t.read("region").select("r_regionkey", "r_name")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    one = F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit(" "), F.lower("r_name"))).otherwise(F.col("n_name"))
    return rows.select("n_nationkey", checks.team_names(one, F.col("r_name")).alias("reason"))


@query
def upload_status(t):
    pages = t.read("pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, ".txt").otherwise(".MP4")).alias("file_name"))
    size = F.col("page_id") * 100_000_000
    return pages.select("page_id", checks.upload(F.col("file_name"), size, text.is_video(F.col("file_name"))).alias("status"))


@query
def video_suffix_filter(t):
    ends = F.element_at(F.array(*map(F.lit, [".mp4", ".MOV", ".avi", ".mkv", ".webm", ""])), (F.col("page_id") % 6 + 1).cast("int"))
    names = t.read("pages").select("page_id", F.concat(F.col("page_id").cast("string"), ends).alias("file_name"))
    return names.select("page_id", "file_name", text.suffix(F.col("file_name")).alias("suffix"), text.is_video(F.col("file_name")).alias("accepted"))


@query
def job_status(t):
    return store.job_status(t.jobs())


@query
def job_results(t):
    """Results asked for: of every match, and of as many jobs that are not there."""
    ids = t.jobs().select("job_id")
    return store.job_results(ids.unionByName(ids.select(F.concat("job_id", F.lit("x")).alias("job_id"))), t.jobs())


@query
def match_config_check(t):
    """Which colours and names would be refused as team settings."""
    n = t.read("nation")
    value = F.when(F.col("n_nationkey") % 4 == 0, F.lit("blue")).otherwise(F.concat(F.lit("#"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")))
    reason = checks.team_setting(F.col("n_regionkey"), F.col("n_name"), colour.hex_to_rgb(value))
    return n.select("n_nationkey", value.alias("color"), F.col("n_regionkey").alias("team_id"), reason.alias("reason"))


@query
def identity_snapshot(t):
    sure = t.ocr_candidates.where("confidence >= 0.5")
    rows = idn.snapshot(sure, tr.top_crops(tr.scored_crops(t.crops)), t.known_teams(), t.shirt("number"), t.shirt("name"))
    return rows.withColumns({k: F.array_join(k, "|") for k in ("jersey_candidates", "name_candidates")})


def kit_samples(t: Tables) -> DataFrame:
    """Colours with an area and an id; every seventh match has one colour only, and every eleventh one sample."""
    one = lambda k: F.when(F.col("match_id") % 7 == 3, F.lit(40.0)).otherwise(F.col(k)).alias(k)
    rows = t.player_colors.where("match_id % 11 <> 4 OR frame_num = 0")
    return rows.select("match_id", *map(one, "bgr"), (F.col("frame_num") % 50 + 40).alias("area"), (F.col("match_id") * 100 + F.col("frame_num")).alias("sample_id"))


@query
def team_calibration(t):
    return calibrate.calibrate_teams(kit_samples(t))


@query
def team_candidates(t):
    """What the job of a match says of its kits."""
    return calibrate.candidates_json(calibrate.calibrate_teams(kit_samples(t)))


@query
def team_names(t):
    """Short names cut from what was read, with the marker colour of the same frame, resolved to the match's kit clusters."""
    token = F.upper(F.substring(F.col("text"), F.lit(1), (2 + F.col("frame_num") % 5).cast("int")))
    read = t.ocr_candidates.select("match_id", "frame_num", token.alias("token"), "confidence", (F.col("frame_num") % 100).alias("at"))
    marks = t.player_colors.select("match_id", F.col("frame_num").alias("at"), "b", "g", "r")
    return resolve_names(read.join(marks, ["match_id", "at"]), calibrate.kit_clusters(kit_samples(t)))


@query
def kit_color_udf(t):
    """Crops painted from a shirt colour on a green background, and the colour found again."""
    c = t.player_colors
    pixel = lambda *v: F.concat(*[F.lpad(F.hex(x.cast("int")), 2, "0") for x in v])
    channel = lambda k: F.least(F.greatest(F.col(k), F.lit(0)), F.lit(255))
    shirt, ground = pixel(channel("b"), channel("g"), channel("r")), F.lit("1EC81E")
    line = F.concat(F.repeat(ground, 2), F.repeat(shirt, 6), F.repeat(ground, 2))
    image = F.unhex(F.concat(F.repeat(ground, 10), F.repeat(line, 6)))
    rows = c.select("match_id", "frame_num", "track_id", calibrate.kit_colour(image, F.lit(7), F.lit(10)).alias("k"))
    return rows.select("match_id", "frame_num", "track_id", *[F.round(f"k.{x}", 4).alias(x) for x in "bgr"])


#: Hidden units of the event network, and vectors that its weights are cut from where no trained ones are at hand.
HIDDEN = 128
WEIGHT_VECTORS = 500


def network_weights(t: Tables) -> dict[str, np.ndarray]:
    """Weights of the network's shapes, cut from the first vectors of the table (``WEIGHT_VECTORS`` of 64 values)."""
    rows = t.read("embeddings").where(F.col("vec_id") < WEIGHT_VECTORS).orderBy("vec_id").select("embedding").collect()
    e, gates = np.array([r["embedding"] for r in rows], dtype=float), np.arange(4 * HIDDEN)
    at = lambda k: e[k % len(e)]
    out = np.arange(3)
    return {
        "wx": 0.5 * at(gates).T, "wh": 0.25 * np.hstack([at(gates + 7), at(gates + 13)]).T, "b": at(3 * gates)[gates, gates % 64],
        "wo": np.hstack([at(out + 100), at(out + 200)]).T, "bo": at(out + 300)[:, 0],
    }


@query
def lstm_event_udf(t):
    """Scores of a recurrent network of 128 units whose weights are read from a table."""
    folder = f"{shared_folder(t.spark)}/weights-{uuid.uuid4().hex}"
    calibrate.save_weights(t.spark, network_weights(t), folder)
    windows = tr.feature_windows(t.features)
    scored = windows.select("match_id", "frame_num", calibrate.event_scores(F.col("sequence"), calibrate.load_weights(t.spark, folder)).alias("p"))
    names = F.array(F.lit("goal"), F.lit("foul"), F.lit("none"))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return scored.select("match_id", "frame_num", F.element_at(names, best).alias("event"), F.round(F.array_max("p"), 6).alias("confidence"))


def streamed(t: Tables, batch: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Play the rows back in time order, a slot of frames a trigger, and read what the operator appended.

    Half of the slots come first; the query then ends, and starts again from its checkpoint for the rest.
    """
    replay = Replay(batch)
    replay.play(replay.slots // 2)
    if replay.played:
        replay.run(operator)
    replay.play()
    replay.run(operator)
    return replay.result()


@query
def tracks_assigned(t):
    """Tracks of the detections, found anew: their own ids are not used."""
    return assign_tracks(t.detections.drop("track_id"))


@query
def stream_tracks(t):
    return streamed(t, t.detections.drop("track_id"), st.stream_tracks)


@query
def job_progress(t):
    """How far a run has come after each of its triggers, as the stream itself reports it."""
    replay = Replay(t.frames)
    replay.play()
    return replay.progress([replay.run(lambda rows: rows.select("match_id", "frame_num"))])


@query
def store_read_back(t):
    """The store as its manifest names it, after two saves: of all matches, then again of those with an even number."""
    path = f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}"
    stored = {k: staged(v) for k, v in t.stored().items()}
    files.save_store(stored, path)
    files.save_store({k: v.where("match_id % 2 = 0") for k, v in stored.items() if k in ("plays", "events")}, path)
    tables = files.read_store(t.spark, path)
    one = lambda name, key: tables[name].select(F.lit(name).alias("name"), "match_id", F.col(key).alias("id"))
    return one("plays", "play_id").unionByName(one("events", "event_id")).unionByName(one("occurrences", "occurrence_id"))


@query
def result_json(t):
    """The result of every match's job, as the poll returns it."""
    stored = {k: staged(v) if k in ("occurrences", "players") else v for k, v in t.stored().items()}  # both are read several times
    objects = store.match_objects(stored, t.teams.withColumn("primary_color", F.lit("#000000")))
    jobs = t.jobs().withColumn("match_id", F.regexp_extract("job_id", "[0-9]+", 0).cast("long")).drop("result")
    told = store.job_results(jobs.select("job_id"), jobs.join(store.result_json(objects), "match_id"))
    sheet = F.from_json("result", "score_sheet array<struct<team:string,score:long>>")["score_sheet"]
    told = told.withColumns({"goals": F.aggregate(sheet, F.lit(0).cast("long"), lambda s, x: s + x["score"]), "teams": F.size(sheet)})
    return told.select("job_id", "code", F.when(F.col("code") == 200, F.col("goals")).alias("goals"), F.when(F.col("code") == 200, F.col("teams")).alias("teams"))


def grey_crops(t: Tables) -> DataFrame:
    """Vectors of 64 values as grey crops of 8 by 8 points."""
    grey = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor((x.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("long")), 2, "0"))
    side = F.lit(8).alias
    return t.features.select("match_id", "frame_num", F.unhex(F.array_join(grey, "")).alias("image"), side("height"), side("width"))


def points(image: str) -> Column:
    """The points of a crop as whole numbers."""
    return F.transform(F.sequence(F.lit(1), F.length(image)), lambda i: F.conv(F.hex(F.substring(F.col(image), i, F.lit(1))), 16, 10).cast("long"))


@query
def crop_sharpness(t):
    """Times 64 * 64 the variance is a whole number."""
    sharp = calibrate.sharpness(F.col("image"), F.col("height"), F.col("width"))
    return grey_crops(t).select("match_id", "frame_num", F.round(sharp * 4096).cast("long").alias("sharpness"))


@query
def crop_variants(t):
    """What the points of both variants of every crop add up to."""
    rows = boundary.crop_variants(grey_crops(t)).withColumn("points", points("image"))
    total = F.aggregate("points", F.lit(0).cast("long"), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("points", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("match_id", "frame_num", "variant", total.alias("total"), weighted.alias("weighted"))


class Spots:
    """A small detector: the brightest point of an image is the ball, the darkest a player, each as sure as it is extreme."""

    def __call__(self, images: list[bytes]) -> list[list[tuple]]:
        out = []
        for image in images:
            high, low = max(image), min(image)
            i, j = image.index(high), image.index(low)
            box = lambda k: (k % 8, k // 8, k % 8 + 1, k // 8 + 1)
            out.append([("ball", high / 255, *box(i)), ("player", (255 - low) / 255 / 2, *box(j))])
        return out


@query
def model_detections(t):
    """Detections by a small model in batches, of all vectors as images."""
    return boundary.detect(grey_crops(t), Spots(), least=0.45).withColumn("confidence", F.round("confidence", 6))


def first_points():
    """An engine that reads a number off the first point, as sure as the second, and fails where the first is divisible by seven."""

    def read(image: bytes) -> list[tuple[str, float]]:
        if image[0] % 7 == 0:
            raise RuntimeError("unreadable")
        return [(str(image[0] % 23), image[1] / 200), (f"NO {image[2]}", 0.25)]

    return read


def no_engine():
    raise RuntimeError("no engine")


@query
def model_readings(t):
    """Readings by a small engine, with crops that it fails on, and those of matches with an odd number by one that is not there."""
    crops = grey_crops(t).select("match_id", (F.col("frame_num") % 22 + 1).alias("track_id"), "frame_num", F.lit(0.5).alias("quality"), "image")
    read = boundary.read_crops(crops.where("match_id % 2 = 0"), first_points).unionByName(boundary.read_crops(crops.where("match_id % 2 = 1"), no_engine))
    return read.withColumn("confidence", F.round("confidence", 6))


@query
def stream_cooldown(t):
    return streamed(t, ev.eligible(t.detected_events, ev.presence(t.tracks, t.ball)), st.stream_cooldown)


@query
def stream_last_touch(t):
    touches = t.touchers().select("match_id", "frame_num", "track_id")
    goals = t.goals().select("match_id", F.col("goal_frame").alias("frame_num"), F.lit(None).cast("long").alias("track_id"))
    return streamed(t, touches.unionByName(goals), st.stream_last_touch)


@query
def stream_goal_crops(t):
    crops = tr.scored_crops(t.crops).select("match_id", "frame_num", "track_id", "score", "quality")
    none = F.lit(None).cast("double")
    goals = t.scorers().select("match_id", F.col("goal_frame").alias("frame_num"), "track_id", none.alias("score"), none.alias("quality"))
    return streamed(t, crops.unionByName(goals), st.stream_goal_crops)


@query
def stream_feature_windows(t):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    rows = streamed(t, t.features, st.stream_feature_windows)
    return rows.select("match_id", "frame_num", F.size("sequence").alias("steps"), F.round(total(F.col("sequence")[0]), 4).alias("first_sum"), F.round(total(F.col("sequence")[9]), 4).alias("last_sum"))


@query
def stream_sticky_team(t):
    return streamed(t, t.kits().select("match_id", "frame_num", "track_id", "team_id"), st.sticky_teams)


@query
def stream_match(t):
    """The list of scorers, from a loop with one state per match; numbers and names are read from the crops that it gives."""
    events = ev.eligible(t.detected_events, ev.presence(t.tracks, t.ball))
    rows = loop.loop_rows(t.team_frames, tr.scored_crops(t.crops), pos.nearest_player(t.tracks, t.ball), events)
    before = t.spark.conf.get(*loop.PROVIDER)
    t.spark.conf.set(*loop.PROVIDER)
    try:
        goals = staged(streamed(t, rows, loop.attributed_goals))
    finally:
        t.spark.conf.set(loop.PROVIDER[0], before)
    names = t.plays.join(t.teams, "team_id").select("match_id", F.col("team_slot").alias("team_id"), "team_name")
    goals = goals.join(names, ["match_id", "team_id"], "left").withColumn("team_name", F.coalesce("team_name", F.lit("unknown_team")))
    crops = goals.select("match_id", "goal_frame", "track_id", F.inline(F.arrays_zip("crop_frames", "crop_qualities"))).toDF("match_id", "goal_frame", "track_id", "crop_frame", "quality")
    return t.with_readings(goals, crops).select(*SCORER)

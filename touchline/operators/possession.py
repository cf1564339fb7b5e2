"""Who has the ball: nearest player, possession, the last touch before a goal, ball control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.operators.identity import team_as_of

REACH = 70.0
LOOKBACK = 180
RECENT = 12


def nearest_player(tracks: DataFrame, ball: DataFrame, reach: float = REACH) -> DataFrame:
    """(match_id, frame_num, track_id, distance): the player whose foot corner is nearest the ball, if within reach."""
    bx, by = geo.center()
    at = ball.select("match_id", "frame_num", bx.alias("bx"), by.alias("by"))
    rows = tracks.join(at, ["match_id", "frame_num"])
    left = geo.distance(F.col("x1"), F.col("y2"), F.col("bx"), F.col("by"))
    right = geo.distance(F.col("x2"), F.col("y2"), F.col("bx"), F.col("by"))
    rows = rows.withColumn("distance", F.least(left, right)).where(F.col("distance") < reach)
    best = rows.groupBy("match_id", "frame_num").agg(F.min(F.struct("distance", "track_id")).alias("m"))
    return best.select("match_id", "frame_num", "m.track_id", "m.distance")


def possession(nearest: DataFrame, known: DataFrame) -> DataFrame:
    """Touches with the toucher's team at that time; 0 and unknown_team where it is not known by then. known: see ``identity.team_as_of``."""
    return team_as_of(nearest.where(F.col("track_id") >= 0), known)


def touches_before(goals: DataFrame, touches: DataFrame, lookback: int = LOOKBACK, how: str = "inner") -> DataFrame:
    """Each goal with the touches of the lookback frames up to it, as a struct, null where a left join finds none: an
    equi-join on buckets, then the exact band.

    goals: match_id, goal_frame. A goal falls in its bucket of ``lookback`` + 1 frames and the one before; a touch
    in its own; so both sides stay hash-partitioned and no row meets more than two buckets.
    """
    width = lookback + 1
    own = F.floor(F.col("goal_frame") / width)
    g = goals.withColumn("__bucket", F.explode(F.array(own, own - 1)))
    t = touches.withColumn("__bucket", F.floor(F.col("frame_num") / width))
    rows = g.join(t.select("match_id", "__bucket", F.struct("frame_num", "track_id").alias("touch")), ["match_id", "__bucket"], how)
    near = F.col("touch.frame_num").between(F.col("goal_frame") - lookback, F.col("goal_frame"))
    rows = rows.withColumn("touch", F.when(near, F.col("touch"))).drop("__bucket")
    return rows if how == "left" else rows.where("touch is not null")


def last_touch(goals: DataFrame, touches: DataFrame, lookback: int = LOOKBACK, recent: int = RECENT, all_goals: bool = False) -> DataFrame:
    """The last touch before each goal, and the share of the toucher among the last touches.

    Goals without a touch are absent, or with ``all_goals`` there with nulls. A goal gathers its touches, which are at most
    one a frame of the lookback.
    """
    rows = touches_before(goals.select("match_id", "goal_frame"), touches.select("match_id", "frame_num", "track_id"), lookback, "left" if all_goals else "inner")
    found = rows.groupBy("match_id", "goal_frame").agg(F.sort_array(F.collect_list("touch"), asc=False).alias("t"))
    last, few = F.get("t", F.lit(0)), F.slice("t", 1, recent)
    same = F.try_divide(F.size(F.filter(few, lambda x: x["track_id"] == last["track_id"])), F.size(few))
    return found.select("match_id", "goal_frame", last["track_id"].alias("track_id"), last["frame_num"].alias("last_touch_frame"), geo.half_even(same, 3).alias("possession_confidence"))


def ring(samples: DataFrame, keep: int = 600) -> DataFrame:
    """The last samples of every match."""
    order = Window.partitionBy("match_id").orderBy(F.desc("frame_num"), F.desc("track_id"))
    return samples.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= keep).drop("__k")


def ball_control(frames: DataFrame, touches: DataFrame) -> DataFrame:
    """Running share of team 1 and 2 among the frames since a team first had the ball, each frame held by the last."""
    teams = touches.where("team_id in (1, 2)").select("match_id", "frame_num", "team_id")
    rows = frames.select("match_id", "frame_num").distinct().join(teams, ["match_id", "frame_num"], "left")
    order = Window.partitionBy("match_id").orderBy("frame_num").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("holder", F.last("team_id", ignorenulls=True).over(order)).where("holder is not null")
    share = lambda k: F.avg((F.col("holder") == k).cast("double")).over(order)
    return rows.select("match_id", "frame_num", "holder", share(1).alias("team_1_share"), share(2).alias("team_2_share"))

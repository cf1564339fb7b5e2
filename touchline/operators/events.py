"""From classifier output to confirmed events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COOLDOWN = 60
START = -100


def presence(tracks: DataFrame, ball: DataFrame) -> DataFrame:
    """(match_id, frame_num, players, has_ball) of frames with either."""
    players = tracks.groupBy("match_id", "frame_num").agg(F.count_distinct("track_id").alias("players"))
    balls = ball.select("match_id", "frame_num").distinct().withColumn("has_ball", F.lit(True))
    rows = players.join(balls, ["match_id", "frame_num"], "full")
    return rows.na.fill(0, ["players"]).na.fill(False, ["has_ball"])


def eligible(detected: DataFrame, present: DataFrame, goal: float = 0.5, other: float = 0.7) -> DataFrame:
    """Detected events sure enough for their type: goals need the ball, fouls more than one player, none is no event."""
    rows = detected.where("event <> 'none'").join(present, ["match_id", "frame_num"], "left")
    ball, players = F.coalesce("has_ball", F.lit(False)), F.coalesce("players", F.lit(0))
    fits = (
        F.when(F.col("event") == "goal", (F.col("confidence") >= goal) & ball)
        .when(F.col("event") == "foul", (F.col("confidence") >= other) & (players > 1))
        .otherwise(F.col("confidence") >= other)
    )
    return rows.where(fits).select(*detected.columns)


def accepted(detected: DataFrame, types: Sequence[str] = ("goal", "foul")) -> DataFrame:
    """Detected events of the given types; others are passed over."""
    return detected.where(F.col("event").isin(*types))


def spaced(frames: Column, cooldown: int, start: int = START) -> Column:
    """Of frames in order, those at least ``cooldown`` after the last one taken."""
    first = F.struct(F.lit(start).cast("long").alias("last"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda s, x: F.when(x - s["last"] < cooldown, s).otherwise(F.struct(x.alias("last"), F.array_append(s["taken"], x).alias("taken")))
    return F.aggregate(frames, first, step, lambda s: s["taken"])


def with_cooldown(events: DataFrame, cooldown: int = COOLDOWN, by: tuple[str, ...] = ("match_id",), start: int = START) -> DataFrame:
    """Events confirmed greedily: in frame order, one starts a pause for all others of the same ``by``.

    A fold over the frames of one match (bounded by its length) in the JVM; of several events in a frame the
    first by type is taken.
    """
    frames = events.groupBy(*by).agg(F.array_sort(F.collect_set("frame_num")).alias("f"))
    taken = frames.select(*by, F.explode(spaced(F.col("f"), cooldown, start)).alias("frame_num"))
    order = Window.partitionBy(*by, "frame_num").orderBy("event", F.desc("confidence"))
    first = events.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return first.join(taken, [*by, "frame_num"], "left_semi")


def peaks(scores: DataFrame, thresholds: Mapping[str, float], reach: int = 5, skip: int = 2) -> DataFrame:
    """Every ``skip``-th frame whose score is over its class's threshold and the highest of the last ``reach`` and itself."""
    limits = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    rows = scores.where((F.col("frame_num") + 1) % skip == 0)
    order = Window.partitionBy("match_id", "event").orderBy("frame_num").rowsBetween(-reach, 0)
    rows = rows.withColumn("__top", F.max("confidence").over(order))
    over = F.col("confidence") > F.element_at(limits, F.col("event"))
    return rows.where(over & (F.col("confidence") == F.col("__top"))).drop("__top")


def score_sheet(plays: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals of both teams of every match, 0 included. goals: match_id, team_slot."""
    count = goals.where("team_slot in (1, 2)").groupBy("match_id", "team_slot").agg(F.count("*").alias("score"))
    return plays.join(count, ["match_id", "team_slot"], "left").na.fill(0, ["score"])

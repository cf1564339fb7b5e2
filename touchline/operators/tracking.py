"""Operators on tracks: classes, the ball, camera movement, interpolation, speed and crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo

FPS = 24


def remap_classes(detections: DataFrame, classes: Sequence[str], least: float = 0.1) -> DataFrame:
    """Detections sure enough; a goalkeeper counts as a player where the detector knows players."""
    sure = detections.where(F.col("confidence") >= least)
    if "player" not in classes:
        return sure
    keeper = F.col("object_class") == "goalkeeper"
    return sure.withColumn("object_class", F.when(keeper, F.lit("player")).otherwise(F.col("object_class")))


def split_classes(detections: DataFrame, classes: Sequence[str], least: float = 0.1) -> dict[str, DataFrame]:
    """players, referees and ball of the detections, goalkeepers among the players; the ball is the last one of a frame."""
    rows = remap_classes(detections, classes, least)
    kind = lambda name: rows.where(F.col("object_class") == name)
    return {"players": kind("player"), "referees": kind("referee"), "ball": last_ball(kind("ball"), least)}


def number_frames(frames: DataFrame, order: str) -> DataFrame:
    """frames with frame_num, from 0 without gaps in every match, by the column ``order``, which is left out."""
    number = F.row_number().over(Window.partitionBy("match_id").orderBy(order)) - 1
    return frames.withColumn("frame_num", number.cast("long")).drop(order)


def last_ball(detections: DataFrame, least: float = 0.1) -> DataFrame:
    """One ball a frame: the last that was detected."""
    box = F.struct("x1", "y1", "x2", "y2")
    best = detections.where(F.col("confidence") >= least).groupBy("match_id", "frame_num").agg(F.max_by(box, "det_order").alias("b"))
    return best.select("match_id", "frame_num", F.lit(1).alias("track_id"), "b.*")


def pair_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Feature points of a frame before and after, by index. old, new: match_id, frame_num, feature_idx, x, y."""
    key = ["match_id", "frame_num", "feature_idx"]
    return old.withColumnsRenamed({"x": "old_x", "y": "old_y"}).join(new.withColumnsRenamed({"x": "new_x", "y": "new_y"}), key)


def camera_movement(pairs: DataFrame, least: float = 5.0) -> DataFrame:
    """(match_id, frame_num, dx, dy): the largest displacement of a feature point, the first of equal ones; small ones are 0."""
    moved = pairs.select("match_id", "frame_num", "feature_idx", (F.col("old_x") - F.col("new_x")).alias("dx"), (F.col("old_y") - F.col("new_y")).alias("dy"))
    far = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    top = moved.groupBy("match_id", "frame_num").agg(F.max(F.struct(far.alias("far"), (-F.col("feature_idx")).alias("k"), "dx", "dy")).alias("m"))
    keep = lambda c: F.when(F.col("m.far") > least, F.col(f"m.{c}")).otherwise(0.0).alias(c)
    return top.select("match_id", "frame_num", keep("dx"), keep("dy"))


def flow_features(movement: DataFrame) -> DataFrame:
    """(match_id, frame_num, features_from): the frame whose feature points are followed into a frame, the first of the match or the
    last one before it in which the camera moved; points are taken anew only then. movement: as ``camera_movement`` returns it."""
    order = Window.partitionBy("match_id").orderBy("frame_num").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.last(F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.col("frame_num")), ignorenulls=True).over(order)
    return movement.select("match_id", "frame_num", F.coalesce(moved, F.first("frame_num").over(order)).alias("features_from")).where("features_from is not null")


def adjust_positions(positions: DataFrame, movement: DataFrame, keys: Sequence[str] = ("match_id", "frame_num")) -> DataFrame:
    """px, py less the camera's movement in that frame."""
    moved = positions.join(movement, list(keys), "left")
    return moved.withColumns(
        {"ax": F.col("px") - F.coalesce("dx", F.lit(0.0)), "ay": F.col("py") - F.coalesce("dy", F.lit(0.0))}
    ).drop("dx", "dy")


def interpolate(frames: DataFrame, seen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a frame: values between sightings on a line, before the first and after the last held constant."""
    rows = frames.select("match_id", "frame_num").distinct().join(seen, ["match_id", "frame_num"], "left")
    # Both windows start at an end of the match and grow, so each row is looked at once; the later one runs backwards.
    match = Window.partitionBy("match_id")
    before, after = (match.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("frame_num", F.desc("frame_num")))
    point = F.when(F.col(columns[0]).isNotNull(), F.struct("frame_num", *columns))
    rows = rows.withColumns({"__p": F.last(point, ignorenulls=True).over(before), "__n": F.last(point, ignorenulls=True).over(after)})
    share = F.try_divide(F.col("frame_num") - F.col("__p.frame_num"), F.col("__n.frame_num") - F.col("__p.frame_num"))

    def value(c: str):
        p, n = F.col(f"__p.{c}"), F.col(f"__n.{c}")
        return F.coalesce(F.when(F.col(c).isNotNull(), F.col(c)), p + (n - p) * share, p, n)

    return rows.withColumns({c: value(c) for c in columns}).drop("__p", "__n")


def speed_distance(positions: DataFrame, frames: DataFrame, window: int = 5, fps: float = FPS) -> DataFrame:
    """speed (km/h) and distance so far, for rows of every window of frames whose two ends are on the pitch.

    positions: match_id, track_id, frame_num, x, y (null off the pitch). A window goes from its first frame to the
    next window's, or to the match's last frame; one without length is left out.
    """
    last = frames.groupBy("match_id").agg((F.max("frame_num")).alias("last_frame"))
    known = positions.where("x is not null and y is not null")
    start = known.where(F.col("frame_num") % window == 0).join(last, "match_id")
    start = start.withColumn("end_frame", F.least(F.col("frame_num") + window, F.col("last_frame"))).where("end_frame > frame_num")
    ends = known.select("match_id", "track_id", F.col("frame_num").alias("end_frame"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    spans = start.join(ends, ["match_id", "track_id", "end_frame"])
    far = geo.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))
    running = Window.partitionBy("match_id", "track_id").orderBy("frame_num").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("far", far).withColumn("distance", F.sum("far").over(running))
    speed = F.col("far") / ((F.col("end_frame") - F.col("frame_num")) / F.lit(float(fps))) * 3.6
    spans = spans.select("match_id", "track_id", F.floor(F.col("frame_num") / window).alias("w"), "end_frame", speed.alias("speed"), "distance")
    rows = positions.select("match_id", "track_id", "frame_num", F.floor(F.col("frame_num") / window).alias("w"))
    rows = rows.join(spans, ["match_id", "track_id", "w"]).where(F.col("frame_num") < F.col("end_frame"))
    return rows.select("match_id", "track_id", "frame_num", "speed", "distance")


def scored_crops(crops: DataFrame, stride: int = 3) -> DataFrame:
    """Every stride-th frame's crops with their quality and rank score; with a stride of 1 or less all rows, also those without a frame."""
    c = F.col
    quality = geo.crop_quality(c("h"), c("w"), c("sharpness"), c("rear_facing_score"))
    rows = crops.where(c("frame_num") % stride == 0) if stride > 1 else crops
    return rows.withColumn("quality", quality).withColumn("score", c("quality") + 0.25 * c("rear_facing_score"))


def top_crops(crops: DataFrame, keep: int = 16) -> DataFrame:
    """The best crops of every track, by score, then by the later frame."""
    order = Window.partitionBy("match_id", "track_id").orderBy(F.desc("score"), F.desc("frame_num"))
    return crops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def crops_as_of(goals: DataFrame, crops: DataFrame, keep: int = 8) -> DataFrame:
    """For each goal (match_id, goal_frame, track_id) the best crops of the scorer up to the goal."""
    c = crops.select("match_id", "track_id", F.col("frame_num").alias("crop_frame"), "score", "quality")
    rows = goals.join(c, ["match_id", "track_id"]).where(F.col("crop_frame") <= F.col("goal_frame"))
    order = Window.partitionBy("match_id", "goal_frame").orderBy(F.desc("score"), F.desc("crop_frame"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def sample_frames(frames: DataFrame, fps: float = 25.0, seconds: int = 45, samples: int = 12) -> DataFrame:
    """Evenly spaced frames of the first seconds of every match; frames that are missing are left out."""
    ends = frames.groupBy("match_id").agg(F.count("*").alias("n"))
    end = F.least(F.greatest(F.col("n") - 1, F.lit(0)), F.lit(int((fps or 25.0) * seconds)))
    at = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.floor(i * end / (samples - 1)).cast("long"))
    wanted = ends.select("match_id", F.explode(F.array_distinct(at)).alias("frame_num"))
    return wanted.join(frames, ["match_id", "frame_num"], "left_semi")


def feature_windows(features: DataFrame, length: int = 10) -> DataFrame:
    """The last ``length`` feature vectors of every frame that has so many."""
    order = Window.partitionBy("match_id").orderBy("frame_num").rowsBetween(1 - length, 0)
    rows = features.withColumn("sequence", F.collect_list("embedding").over(order))
    return rows.where(F.size("sequence") == length).drop("embedding")


def movement_labels(movement: DataFrame) -> DataFrame:
    """What an overlay says of the camera in each frame."""
    shown = lambda axis, v: F.concat(F.lit(f"Camera Movement {axis}: "), F.format_string("%.2f", v))
    return movement.select("match_id", "frame_num", shown("X", F.col("dx")).alias("x_text"), shown("Y", F.col("dy")).alias("y_text"))


def annotations(tracks: DataFrame) -> DataFrame:
    """Where an overlay would be drawn: ellipse at the feet, marker above the head, label box."""
    cx, _ = geo.center()
    width = F.col("x2") - F.col("x1")
    top = F.col("y1").cast("int")
    return tracks.select(
        "match_id", "frame_num", "track_id", cx.alias("ellipse_x"), F.col("y2").cast("int").alias("ellipse_y"),
        width.cast("int").alias("axis_x"), (width * 0.35).cast("int").alias("axis_y"), cx.alias("marker_x"), top.alias("marker_y"),
        (cx - 10).alias("marker_left"), (cx + 10).alias("marker_right"), (top - 20).alias("marker_top"), (top - 24).alias("label_y"),
    )

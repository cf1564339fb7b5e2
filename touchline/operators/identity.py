"""Who a track is: sticky teams, and shirt numbers and names by weighted consensus of what was read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as tx
from touchline.functions.geometry import half_even


def sticky(assigned: DataFrame) -> DataFrame:
    """A track's first known team holds from then on; before that its rows keep their own."""
    order = Window.partitionBy("match_id", "track_id").orderBy("frame_num").rowsBetween(Window.unboundedPreceding, 0)
    known = F.first(F.when(F.col("team_id") != 0, F.struct("team_id", "confidence")), ignorenulls=True).over(order)
    rows = assigned.withColumn("__k", known)
    return rows.withColumns(
        {"team_id": F.coalesce("__k.team_id", "team_id"), "confidence": F.coalesce("__k.confidence", "confidence")}
    ).drop("__k")


def first_known(assigned: DataFrame) -> DataFrame:
    """The first known team of every track and since when: what ``sticky`` gives from that frame on, a row a track."""
    extra = [c for c in assigned.columns if c not in ("match_id", "track_id", "frame_num")]
    known = assigned.where("team_id <> 0").groupBy("match_id", "track_id").agg(F.min(F.struct("frame_num", *extra)).alias("k"))
    return known.select("match_id", "track_id", F.col("k.frame_num").alias("since"), *[f"k.{c}" for c in extra])


def team_as_of(rows: DataFrame, known: DataFrame, at: str = "frame_num") -> DataFrame:
    """rows with team_id and team_name of their track as known in the frame ``at``; 0 and unknown_team before that.

    known: match_id, track_id, since, team_id, team_name (as ``first_known`` returns them).
    """
    k = known.select("match_id", "track_id", "since", F.col("team_id").alias("__team"), F.col("team_name").alias("__name"))
    rows = rows.join(k, ["match_id", "track_id"], "left")
    by_then = F.coalesce(F.col("since") <= F.col(at), F.lit(False))
    return rows.withColumns(
        {
            "team_id": F.when(by_then, F.col("__team")).otherwise(0),
            "team_name": F.coalesce(F.when(by_then, F.nullif("__name", F.lit(""))), F.lit("unknown_team")),
        }
    ).drop("since", "__team", "__name")


def readings_as_of(goals: DataFrame, candidates: DataFrame, crops: DataFrame) -> DataFrame:
    """Candidates read from the crops that count for a goal, with match_id, goal_frame, track_id and the crop's quality.

    crops: match_id, goal_frame, track_id, crop_frame, quality: the best ones of the scorer up to the goal, as
    ``tracking.crops_as_of`` returns them, so that no later reading names a scorer.
    """
    at = crops.select("match_id", "goal_frame", "track_id", F.col("crop_frame").alias("frame_num"), F.col("quality").alias("__quality"))
    rows = candidates.join(at, ["match_id", "track_id", "frame_num"])
    return rows.withColumn("crop_quality", F.col("__quality")).drop("__quality")


def readings(candidates: DataFrame, kind: str, least: float = 0.5) -> DataFrame:
    """Candidates sure enough, a row for each number (or name) that they hold."""
    sure = candidates.where(F.col("confidence") >= least)
    if kind == "number":
        return sure.withColumn("value", F.explode(tx.numbers(F.col("text"))))
    return sure.withColumn("value", tx.name(F.col("text"))).where("value is not null")


def consensus(read: DataFrame, support: int = 2, least: float = 0.58, lead: float = 1.15, by: Sequence[str] = ("match_id", "track_id")) -> DataFrame:
    """Per track, or whatever ``by`` names, the heaviest value, if it has support, confidence and a lead over the next; else null.

    Weight is confidence times quality. Equal weights go to more support, then to higher confidence, then to the
    value read first, then to the lesser value.
    """
    w = F.col("confidence") * F.col("crop_quality")
    total = F.round(F.sum(w), 9)
    groups = read.groupBy(*by, "value").agg(
        total.alias("weight"),
        F.count_distinct("frame_num").alias("support"),
        F.round(F.sum(w) / F.greatest(F.sum("crop_quality"), F.lit(1e-9)), 9).alias("average"),
        F.min("frame_num").alias("first_read"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), F.desc("support"), F.desc("average"), "first_read", "value")
    ranked = groups.withColumns({"rank": F.row_number().over(order), "next_weight": F.lead("weight").over(order)}).where("rank = 1")
    sure = (F.col("support") >= support) & (F.col("average") >= least) & ~F.coalesce(F.col("weight") < lead * F.col("next_weight"), F.lit(False))
    return ranked.select(
        *by, F.when(sure, F.col("value")).alias("value"),
        F.when(sure, half_even(F.col("average"), 3)).otherwise(F.col("average")).alias("confidence"), "support",
    )


def snapshot(candidates: DataFrame, crops: DataFrame, known: DataFrame, numbers: DataFrame, names: DataFrame) -> DataFrame:
    """What is known of every track: team, number, name, the kept crops, and the texts read, in frame order.

    candidates: texts sure enough; crops: the kept ones; known: first known teams with confidence; numbers and names: what
    ``consensus`` returns. Missing teams are 0 and unknown_team with confidence 0.
    """
    key = ["match_id", "track_id"]
    kept = crops.groupBy(*key).agg(F.count("*").alias("crop_count"))
    texts = candidates.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("frame_num", "text"))).alias("t"))
    held = lambda test: F.transform(F.filter("t", lambda x: test(x["text"])), lambda x: x["text"])
    texts = texts.select(*key, held(tx.has_digit).alias("jersey_candidates"), held(tx.has_letter).alias("name_candidates"))
    rows = kept.join(texts, key, "full").join(known.drop("since"), key, "left")
    for table, value, sure in ((numbers, "jersey_number", "jersey_confidence"), (names, "player_name", "name_confidence")):
        rows = rows.join(table.select(*key, F.col("value").alias(value), F.col("confidence").alias(sure)), key, "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *key, F.coalesce("team_id", F.lit(0)).alias("team_id"), F.coalesce("team_name", F.lit("unknown_team")).alias("team_name"),
        F.coalesce("team_confidence", F.lit(0.0)).alias("team_confidence"), "jersey_number", "jersey_confidence", "player_name", "name_confidence",
        F.coalesce("crop_count", F.lit(0)).alias("crop_count"), F.coalesce("jersey_candidates", none).alias("jersey_candidates"),
        F.coalesce("name_candidates", none).alias("name_candidates"),
    )

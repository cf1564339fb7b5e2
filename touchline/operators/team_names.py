"""Names of a match's kit clusters, from the short names that a scoreboard shows beside colours, window by window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import IGNORED_NAMES

#: Frames of a window, and the part of a name's confidence that its colour makes up; agreement over time makes up the rest.
WINDOW = 100
COLOUR = 0.6
#: From this confidence on a name is assigned; from the second on the name assigned before is held.
ASSIGN, HOLD = 0.70, 0.45
_FARTHEST = math.sqrt(3) * 255


def is_token(text: Column) -> Column:
    """Two to five upper-case letters that are no word of a broadcast."""
    return F.coalesce(text.rlike("^[A-Z]{2,5}$") & ~text.isin(IGNORED_NAMES), F.lit(False))


def closeness(c: str) -> Column:
    """1 for a marker of the colour of centre ``c``, 0 for the farthest colour there is."""
    gap = sum((F.col(k) - F.col(f"{k}{c}")) * (F.col(k) - F.col(f"{k}{c}")) for k in "bgr")
    return 1 - F.sqrt(gap) / _FARTHEST


def resolve_names(tokens: DataFrame, centers: DataFrame, window: int = WINDOW) -> DataFrame:
    """match_id, window, cluster_id, name, confidence, band and shown: a row for each cluster of a window with two names.

    tokens: match_id, frame_num, token, confidence, and the colour b, g, r of the marker beside it; rows with a null, and tokens
    that are none (``is_token``), are left out. centers: as ``calibrate.kit_clusters`` returns them. Of a window's tokens the two
    of most weight count, the lesser name first of equal ones; with fewer the window is passed over. They go to the two
    clusters in the way in which their colours are closer in all. confidence: ``COLOUR`` of the closeness, and the rest of the
    share of the match's windows so far in which the cluster had this name. shown: the name if it is assigned, the last
    one assigned before it if the band is hold, else null.
    """
    good = tokens.select("match_id", "frame_num", "token", "confidence", "b", "g", "r").na.drop().where(is_token(F.col("token")))
    near = good.join(centers, "match_id").withColumn("window", F.floor(F.col("frame_num") / window))
    mean = lambda c: F.round(F.try_divide(F.sum(F.col("confidence") * closeness(c)), F.sum("confidence")), 9)
    names = near.groupBy("match_id", "window", "token").agg(F.round(F.sum("confidence"), 9).alias("weight"), mean("0").alias("near_0"), mean("1").alias("near_1"))
    # The two heaviest of a window by a bounded aggregate; their entries are what a row needs.
    order = Window.partitionBy("match_id", "window").orderBy(F.desc("weight"), "token")
    two = names.withColumn("k", F.row_number().over(order)).where("k <= 2").groupBy("match_id", "window").agg(F.array_sort(F.collect_list(F.struct("k", "token", "near_0", "near_1"))).alias("t"))
    two = two.where(F.size("t") == 2)
    a, b = F.col("t")[0], F.col("t")[1]
    straight = F.round(a["near_0"] + b["near_1"], 9) >= F.round(a["near_1"] + b["near_0"], 9)
    first, second = F.when(straight, a).otherwise(b), F.when(straight, b).otherwise(a)
    pair = F.array(F.struct(F.lit(0).alias("cluster_id"), first["token"].alias("name"), first["near_0"].alias("near")), F.struct(F.lit(1).alias("cluster_id"), second["token"].alias("name"), second["near_1"].alias("near")))
    rows = two.select("match_id", "window", F.inline(pair))
    upto = Window.partitionBy("match_id", "cluster_id").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    agree = F.count("*").over(Window.partitionBy("match_id", "cluster_id", "name").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)) / F.count("*").over(upto)
    rows = rows.withColumn("confidence", F.round(COLOUR * F.col("near") + (1 - COLOUR) * agree, 6))
    band = F.when(F.col("confidence") >= ASSIGN, "assign").when(F.col("confidence") >= HOLD, "hold").otherwise("none")
    rows = rows.withColumn("band", band)
    last = F.last(F.when(F.col("band") == "assign", F.col("name")), ignorenulls=True).over(upto)
    return rows.select("match_id", "window", "cluster_id", "name", "confidence", "band", F.when(F.col("band") != "none", last).alias("shown"))

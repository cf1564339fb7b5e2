"""Readers, and adapters that shape the star-schema tables into match tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"]

#: Rows of embeddings that count as one match's.
VECTORS = 100
#: Query texts that Spark SQL and other engines run alike; {name} is a table.
ADAPTERS = {
    "tracks": """
SELECT match_id, frame_num, track_id, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (
 SELECT CAST(floor(l_orderkey / 1000) AS BIGINT) AS match_id, l_orderkey % 1000 AS frame_num, l_suppkey % 22 + 1 AS track_id,
  100 + 30 * max(l_quantity) AS x1,
  CAST(200 + max(CAST(floor(l_extendedprice) AS BIGINT) % 700) AS DOUBLE) AS y1,
  20 + 1000 * max(l_discount) AS w, 40 + 1000 * max(l_tax) AS h
 FROM {lineitem} GROUP BY CAST(floor(l_orderkey / 1000) AS BIGINT), l_orderkey % 1000, l_suppkey % 22 + 1) g""",
    "frames": "SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS match_id, o_orderkey % 1000 AS frame_num FROM {orders}",
    "ball": """
SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS match_id, o_orderkey % 1000 AS frame_num,
 CAST(122 + CAST(floor(o_totalprice) AS BIGINT) % 1500 AS DOUBLE) AS x1, CAST(232 + (o_custkey * 7) % 800 AS DOUBLE) AS y1,
 CAST(138 + CAST(floor(o_totalprice) AS BIGINT) % 1500 AS DOUBLE) AS x2, CAST(248 + (o_custkey * 7) % 800 AS DOUBLE) AS y2
FROM {orders} WHERE o_orderstatus <> 'P'""",
    "detected_events": """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS match_id, event_id % 1000 AS frame_num,
 CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'error' THEN 'foul' WHEN 'signup' THEN 'card' ELSE 'none' END AS event,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 100 AS confidence
FROM {events}""",
    "ocr_candidates": """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS match_id, event_id % 1000 AS frame_num, user_id % 22 + 1 AS track_id,
 CASE event_type WHEN 'click' THEN concat('#', CAST(user_id % 5 AS STRING)) WHEN 'view' THEN r_name
  WHEN 'signup' THEN concat(CAST(user_id % 5 AS STRING), ' ', lower(r_name))
  WHEN 'error' THEN concat('x', regexp_extract(props, '([0-9]+)', 1), '99')
  ELSE concat('LIVE ', regexp_extract(props, '([0-9]+)', 1)) END AS text,
 (40 + event_id * 37 % 61) / 100 AS confidence, (event_id * 53 % 101) / 100 AS crop_quality
FROM {events} JOIN {region} ON r_regionkey = user_id % 5""",
    "crops": """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS match_id, event_id % 1000 AS frame_num, user_id % 22 + 1 AS track_id,
 24 + event_id * 31 % 120 AS h, 16 + event_id * 17 % 90 AS w, value AS sharpness, (event_id % 3) / 2 AS rear_facing_score
FROM {events}""",
    "teams": "SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name FROM {nation}",
    "plays": """
SELECT match_id, team_slot, (match_id + team_slot - 1) % 25 AS team_id FROM
 (SELECT DISTINCT CAST(floor(o_orderkey / 1000) AS BIGINT) AS match_id FROM {orders}) m
 CROSS JOIN (SELECT 1 AS team_slot UNION ALL SELECT 2 AS team_slot) s""",
    "detections": """
SELECT match_id, frame_num, track_id, x1, y1, x2, y2, (frame_num * 37 + track_id * 13) % 100 / 100 AS confidence,
 CASE track_id % 11 WHEN 0 THEN 'referee' WHEN 1 THEN 'goalkeeper' ELSE 'player' END AS object_class
FROM ({tracks}) t""",
    "ball_detections": """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS match_id, CAST(floor(event_id % 1000 / 4) AS BIGINT) AS frame_num, event_id AS det_order,
 value AS x1, value + 1 AS y1, value + 16 AS x2, value + 17 AS y2, (event_id * 29) % 100 / 100 AS confidence
FROM {events}""",
    "feature_pairs": """
SELECT match_id, frame_num, feature_idx, o.x AS old_x, o.y AS old_y, n.x AS new_x, n.y AS new_y
FROM ({old_points}) o JOIN ({new_points}) n USING (match_id, frame_num, feature_idx)""",
    "old_points": """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS match_id, CAST(floor(event_id % 1000 / 100) AS BIGINT) AS frame_num, event_id % 100 AS feature_idx,
 value AS x, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE) AS y
FROM {events}""",
    "new_points": """
SELECT CAST(floor((event_id - 1) / 1000) AS BIGINT) AS match_id, CAST(floor((event_id - 1) % 1000 / 100) AS BIGINT) AS frame_num, (event_id - 1) % 100 AS feature_idx,
 value AS x, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE) AS y
FROM {events} WHERE event_id > 0""",
    "team_frames": """
SELECT match_id, track_id, frame_num, CAST(CASE WHEN track_id % 11 = 0 OR frame_num % 3 = 0 THEN 0 ELSE 1 + track_id % 2 END AS INT) AS team_id,
 CAST(1 AS DOUBLE) - CAST(frame_num % 4 AS DOUBLE) / 8 AS team_confidence
FROM ({tracks}) t""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The match table of that name over the tables in sf_dir."""
    if name == "player_colors":
        channel = lambda k: F.floor((F.element_at("embedding", k).cast("double") + 0.5) * 255).cast("double")
        return read(spark, sf_dir, "embeddings").select(
            F.floor(F.col("vec_id") / VECTORS).alias("match_id"), (F.col("vec_id") % 22 + 1).alias("track_id"), (F.col("vec_id") % VECTORS).alias("frame_num"),
            channel(1).alias("b"), channel(2).alias("g"), channel(3).alias("r"),
        )
    if name == "features":
        return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / VECTORS).alias("match_id"), (F.col("vec_id") % VECTORS).alias("frame_num"), "embedding")
    sources = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    within = {k: ADAPTERS[k].format(**sources) for k in ("tracks", "old_points", "new_points")}
    return spark.sql(ADAPTERS[name].format(**sources, **within))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="tables-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def staged(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: for what several parts of a plan need."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Image sequences as frames, stores as partitioned tables, and checks of names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_frames(spark: SparkSession, folder: str, fps: float = 25.0, pattern: str = "*") -> DataFrame:
    """match_id, frame_num, seconds, image: files named <match>/<frame>.<ending>; other files are passed over.

    Column pruning keeps contents unread where only frame numbers are wanted, and a filter on path prunes files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    parts = lambda k: F.try_to_number(F.regexp_extract("path", r"([0-9]+)/(?:frame_)?([0-9]+)\.[^./]+$", k), F.lit("9" * 18)).cast("long")
    rows = files.select(parts(1).alias("match_id"), parts(2).alias("frame_num"), F.col("content").alias("image"))
    rate = fps if fps > 0 else 25.0
    return rows.where("frame_num is not null").withColumn("seconds", F.col("frame_num") / F.lit(rate))


def save_by_match(df: DataFrame, path: str) -> None:
    """Write a table so that saving a match again replaces just that match, in one commit of the job."""
    df.repartition("match_id").write.partitionBy("match_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


#: The folder of a store's manifests: one for each version, of which the last is the store.
MANIFESTS = "_manifests"


def store_version(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The number of a store's last complete version, and the folder of each table in it; 0 and nothing before the first."""
    try:
        rows = spark.read.schema("version long, name string, folder string").json(f"{path}/{MANIFESTS}/*")
        last = rows.where(F.col("version") == rows.agg(F.max("version").alias("v")).first()["v"]).collect()  # a row a table
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = []
    return (last[0]["version"], {r["name"]: r["folder"] for r in last}) if last else (0, {})


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a store as of its last complete version."""
    _, folders = store_version(spark, path)
    return {name: spark.read.parquet(f"{path}/{folder}") for name, folder in folders.items()}


def save_store(stored: Mapping[str, DataFrame], path: str) -> int:
    """Save tables, such as those of ``store.stored_match``, as the next version of the store under path, in one commit.

    A table with a match keeps the rows of the matches that ``stored`` doesn't hold, any other is replaced; a table that is not
    given stays as it is. New folders are written first, and the manifest that names them last, by one task that puts
    one file in place. Until then readers see the version before, whatever fails; folders without a manifest are nothing
    to them. Occurrences find their match through their event. One writer at a time. Returns the version.
    """
    spark = next(iter(stored.values())).sparkSession
    version, folders = store_version(spark, path)
    tables = dict(stored)
    if "occurrences" in tables and "match_id" not in tables["occurrences"].columns:
        tables["occurrences"] = tables["occurrences"].join(tables["events"].select("event_id", "match_id"), "event_id")
    told = {}
    for name, df in tables.items():
        if "match_id" in df.columns and name in folders:
            before = spark.read.parquet(f"{path}/{folders[name]}")
            df = before.join(df.select("match_id").distinct(), "match_id", "left_anti").unionByName(df, allowMissingColumns=True)
        told[name] = f"{name}/v{version + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{told[name]}")
    rows = [(version + 1, name, folder) for name, folder in (folders | told).items()]
    spark.createDataFrame(rows, "version long, name string, folder string").coalesce(1).write.json(f"{path}/{MANIFESTS}/v{version + 1}")
    return version + 1


def create_database(spark: SparkSession, name: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"not a database name: {name!r}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")

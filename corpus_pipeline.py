"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

What holds for every stage: docs has the columns of documents; further columns, whatever their names, are left out. An
empty docs gives no rows. A stage keeps the rows that its operator keeps, with their ids, and of equal rows all or none,
but for mixing, which repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import new_folder, remove_folder
from touchline.llm.line_dedup import dedup_lines
from touchline.llm.mixing import mix_sources
from touchline.llm.near_dedup import near_duplicates
from touchline.llm.packing import packed_digests
from touchline.llm.quality_rules import score_documents, trusted_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity of near copies in hundredths, and coordinates they agree in but for a chance of 7e-6.
NEAR_PERCENT = 80
NEAR_COLLISIONS = 15


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null or empty text fails them; a row without an id is judged by its text."""
    return score_documents(docs.select(*COLUMNS), trusted_rows(spark, sf_dir)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated runs of lines; those left without a word by it go, and n_chars follows the text.

    A null text, a text without words, and a row without an id stay as they are.
    """
    kept = dedup_lines(docs.select(*COLUMNS)).where(~F.col("emptied"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of 0.8 or more: the one with the least id.

    Documents without words, and rows without an id, are in no group and stay. Rows that repeat an id and text stay together.
    """
    linked = near_duplicates(docs.select(*COLUMNS), percent=NEAR_PERCENT, collisions=NEAR_COLLISIONS, keep_columns=COLUMNS)
    return linked.where("kept").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, in a global shuffle. A null source is one of its own."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences; a null or empty text is the end id alone."""
    return packed_digests(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Hash seeds, winnowing and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written in the shared folder and read again.

    A stage's input is removed once its own result is written, so that no more than two copies are kept at a time; the last
    stage writes its pieces as it is called, and reads nothing else from then on.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        read, folder = folder, new_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        if read:
            remove_folder(spark, read)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove_folder(spark, folder)
    return packed

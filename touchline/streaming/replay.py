"""Tables played back as streams: frames in time order, a bounded number of them a trigger, from a checkpoint on."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.sources.tables import shared_folder
from touchline.streaming.stateful import with_time

#: Triggers that a table is played back in, and files of each, which are its partitions: so many, or more of so many rows.
TRIGGERS = 12
FILES = 4
ROWS_A_FILE = 250_000
#: The match of the row that ends the input by moving the watermark past every frame.
END = -1


class Replay:
    """Rows with match_id and frame_num as a stream, all matches on one clock, in the shared folder.

    The rows are worked out once and written in order of frames, so that reading a slot passes over the others' pages. They are
    then put in slot by slot, a slot being the frames of one trigger, as ``self.files`` files, ``FILES`` or more, of which none is
    empty if the slot has so many rows; the files are read in the order in which they were written, so many a trigger. So a trigger
    has a bounded number of rows, and a query that is stopped goes on from its checkpoint with the slot that comes next.
    """

    def __init__(self, rows: DataFrame, triggers: int = TRIGGERS, files: int = FILES) -> None:
        self.spark: SparkSession = rows.sparkSession
        self.base = f"{shared_folder(self.spark)}/stream-{uuid.uuid4().hex}"
        timed = with_time(rows, apart=0).where("frame_num is not null")
        timed.sortWithinPartitions("frame_num").write.parquet(f"{self.base}/rows")
        self.schema = timed.schema
        self.rows = self.spark.read.schema(self.schema).parquet(f"{self.base}/rows")
        told = self.rows.agg(F.max("frame_num").alias("last"), F.count("*").alias("n")).first()
        self.last = told["last"] or 0
        self.width = max(1, -(-(self.last + 1) // triggers))
        self.slots = self.last // self.width + 1
        self.files = max(files, -(-told["n"] // (self.slots * ROWS_A_FILE)))
        self.played = 0

    def play(self, slots: int | None = None) -> None:
        """Put the next slots, or all, at the end of the input."""
        upto = self.slots if slots is None else min(self.slots, self.played + slots)
        for k in range(self.played, upto):
            own = self.rows.where(F.col("frame_num").between(k * self.width, (k + 1) * self.width - 1))
            own.repartition(self.files).write.parquet(f"{self.base}/in/{k:06d}")
        self.played = upto
        if upto == self.slots:
            last = self.rows.where(F.col("frame_num") == self.last).limit(1)
            last.withColumns({"match_id": F.lit(END).cast("long"), "ts": F.expr("ts + interval 1 day")}).write.parquet(f"{self.base}/in/{upto:06d}")

    def run(self, operator: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
        """Run the operator over what has been played and its checkpoint has not seen, to the end, and return the query."""
        source = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.files).parquet(f"{self.base}/in")
        out = operator(source).writeStream.format("parquet").option("checkpointLocation", f"{self.base}/state")
        query = out.trigger(availableNow=True).start(f"{self.base}/out")
        query.awaitTermination()
        return query

    def progress(self, queries: list[StreamingQuery]) -> DataFrame:
        """What the runs' triggers reported: trigger (from 1), n_rows of it, and the per cent of all rows read by then."""
        seen = [p["numInputRows"] for q in queries for p in q.recentProgress if p["numInputRows"]]
        seen[-1] -= 1  # the row that ends the input
        seen = seen if seen[-1] else seen[:-1]
        total, rows, read = sum(seen), [], 0
        for k, n in enumerate(seen, 1):
            read += n
            rows.append((k, n, round(100 * read / total, 2)))
        return self.spark.createDataFrame(rows, "trigger int, n_rows long, percent double")

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/out").where(F.col("match_id") != END)

"""Collection as Structured Streaming over files: marks, limits and exactly-once batches.

The checkpoint location is the high-water mark.  A batch's data are written before its
commit, under a path of the batch's number, so a crash in between writes the same path
again: no gap, no duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def collect(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, files_per_batch: int = 1, fail_in: int | None = None) -> None:
    """Take what is new under ``source`` (Parquet, oldest files first) into ``sink``; ``fail_in`` breaks that batch after its write."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if fail_in == number:
            raise RuntimeError("broken after the write, before the commit")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def advance(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """New high-water marks (source, key, mark) after rows (source, key, id): the greatest of old and seen."""
    seen = rows.groupBy("source", "key").agg(F.max("id").alias("mark"))
    return marks.select("source", "key", "mark").unionByName(seen).groupBy("source", "key").agg(F.max("mark").alias("mark"))


def beyond(rows: DataFrame, marks: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows after their key's mark (all, where there is none), oldest first, at most ``limit`` a key: a limit leaves no gap."""
    new = rows.join(marks.select("source", "key", "mark"), ["source", "key"], "left").where("mark is null or id > mark").drop("mark")
    if limit is None:
        return new
    w = Window.partitionBy("source", "key").orderBy("id")
    return new.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def within_budget(work: DataFrame, budget: int) -> DataFrame:
    """The beginning of an ordered work list (queue, place, cost) whose running cost stays within the budget, per queue."""
    w = Window.partitionBy("queue").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return work.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= budget)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark (beyond the reference's features)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows of each user (beyond the reference's features)."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))

"""Completion logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows later than this behind the newest are dropped; batch mode drops none.
WATERMARK, GAP = "1 minute", "30 seconds"


def completion_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def sessions(log: DataFrame, run: str, ts: str, length: str, value: str, gap: str = GAP) -> DataFrame:
    """Batches of each run, parted by gaps of more than `gap`: session, size, longest and mean value.

    A session's window ends `gap` after its last row, and Spark merges windows that touch, so rows exactly `gap` apart stay
    together, and those a microsecond further don't. Works on streams, with the watermark, and on tables.
    """
    if log.isStreaming:  # a watermark needs a timestamp with the session's zone
        log = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, WATERMARK)
    window = F.session_window(ts, gap)
    return log.groupBy(run, window.alias("session")).agg(F.count("*").alias("size"), F.max(length).alias("max_length"), F.avg(value).alias("avg_value"))


def append_new(batch_writer, key: list[str], done_path: str, schema: T.StructType):
    """A foreachBatch function that writes the rows of a batch whose key isn't in the output yet, once each."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.schema(schema).json(done_path)
        except Exception as e:  # nothing is written before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        rows = batch.dropDuplicates(key)
        batch_writer(rows if done is None else rows.join(done.select(*key).distinct(), key, "left_anti"))

    return run


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that a stream has now to a folder, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

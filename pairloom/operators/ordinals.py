"""Global row numbers and splits without bringing all rows to one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a temporary one where it is unset and Spark is local, as in tests)."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not hasattr(shared_folder, "own"):
            shared_folder.own = tempfile.mkdtemp(prefix="pairloom-checkpoint-")
        shared = shared_folder.own
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and an executor's loss costs no recomputation before it. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """df with the place of each row (from 0) in an order.

    Rows are dealt to partitions by ranges of the order and numbered there; a partition's first number is the count of
    rows before it. Only counts of partitions meet in one task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = written(placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).drop("_id"), "ordinal")
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")  # a row for each partition


def tail_split(df: DataFrame, *order: Column | str, ratio: float = 0.05, name: str = "is_validation") -> DataFrame:
    """df with a flag for its last floor(n * ratio) rows in an order."""
    numbered = with_ordinal(df, *order, name="_place")
    n = numbered.count()
    return numbered.withColumn(name, F.col("_place") >= n - int(n * ratio)).drop("_place")


def first_by_category(df: DataFrame, category: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each category in an order."""
    w = Window.partitionBy(*category).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def described_first(df: DataFrame, flag: Column, ordinal: str) -> DataFrame:
    """Rows with the flag before those without, otherwise in their order."""
    return df.orderBy(F.when(flag, 0).otherwise(1), ordinal)

"""Readers: JSON lines (strict, lenient, numbered), Parquet, metric documents, rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def json_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Every line must be JSON; blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_lenient(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_counted(spark: SparkSession, path, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with skipped_errors: the lines that aren't JSON)."""
    marked = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    return lines.filter(F.col(f"r.{BAD}").isNull()).select("r.*").drop(BAD), lines.agg(F.count_if(F.col(f"r.{BAD}").isNotNull()).alias("skipped_errors"))


def numbered_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Rows with `_line_number` in their file, blank lines counted, and `_file`; rows that aren't JSON are left out.

    A file is split by Spark between tasks, so lines are counted by their byte order within the file: the text source
    keeps it. Lines are numbered within their piece of the file, after the counts of the pieces before, so that a large
    file isn't numbered in one task.
    """
    from pyspark.sql import Window

    from ..operators.ordinals import written

    place = F.struct(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    text = written(spark.read.text(path).select("value", place.alias("_p"), F.monotonically_increasing_id().alias("_id")).select("value", "_p.*", "_id"), "lines")
    pieces = text.groupBy("_file", "_at").agg(F.count("*").alias("_n"))
    before = pieces.select("_file", "_at", (F.sum("_n").over(Window.partitionBy("_file").orderBy("_at")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_id"))
    ordered = text.join(before, ["_file", "_at"]).withColumn("_line_number", F.col("_before") + nth)
    parsed = ordered.filter("trim(value) <> ''").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json("value").isNotNull()
    return parsed.filter(whole & F.col("r").isNotNull()).select("r.*", F.col("_line_number").cast("long").alias("_line_number"), "_file")


def parquet_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet by path or glob, with the file that each row comes from."""
    return spark.read.parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))


def metric_documents(spark: SparkSession, base: str, kinds: tuple[str, ...] = ("sft_*", "grpo_*", "*base*"), name_filter: str | None = None) -> DataFrame:
    """Metric documents under base/<run>/metrics*/, one row each, with run, temperature and their path; a path counts once.

    Kinds are patterns of run names; `*` or "all" takes every run. The filter looks into the run's name with its
    temperature, "run (temperature)". Documents that can't be read are left out.
    """
    from ..functions.text import temperature_label

    paths = [f"{base}/{'*' if kind == 'all' else kind}/metrics*/metrics_combined_training.json" for kind in kinds]
    read = None
    for path in paths:
        try:
            part = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))
        except Exception as e:  # no run of this kind
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        read = part if read is None else read.unionByName(part, allowMissingColumns=True)
    if read is None:
        raise FileNotFoundError(base)
    folder = F.element_at(F.split("path", "/"), -2)
    read = read.withColumn("run", F.element_at(F.split("path", "/"), -3)).withColumn("temperature", temperature_label(folder)).dropDuplicates(["path"])
    if BAD in read.columns:
        read = read.filter(F.col(BAD).isNull()).drop(BAD)
    label = F.when(F.col("temperature") == "default", F.col("run")).otherwise(F.concat("run", F.lit(" ("), "temperature", F.lit(")")))
    return read.filter(F.lower(label).contains(name_filter.lower())) if name_filter else read


def rollout_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rollout rows with `step`: the number that names their file, or -1, the file, and the file's modification time."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.[^.]*$", 1)
    read = spark.read.schema(schema).json(path)
    return read.withColumns({"step": F.coalesce(F.nullif(stem, F.lit("")).cast("int"), F.lit(-1)), "modified": F.col("_metadata.file_modification_time"), "file": F.col("_metadata.file_path")})


def latest_files(rollouts: DataFrame, n: int = 5) -> DataFrame:
    """Rows of the n files changed last."""
    files = rollouts.select("file", "step", "modified").distinct().orderBy(F.desc("modified"), F.desc("step"), "file").limit(n)
    return rollouts.join(F.broadcast(files.select("file")), "file", "left_semi")  # n rows


def histories(frames: list[DataFrame], by: str = "training/global_step") -> DataFrame:
    """Training histories put together by name, columns that one lacks being null, in the order of their step."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole.orderBy(F.col(f"`{by}`"))

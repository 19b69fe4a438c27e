"""Comparison of runs: metrics flattened, aggregated by series, and sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import series_name
from .quantiles import with_percentiles

METRICS = ("Acc", "F1", "P-C", "P-V", "P-B", "P-R", "Loc F1")


def flattened(documents: DataFrame) -> DataFrame:
    """One row for each run: its metrics under short names."""
    c = lambda path: F.col(path).cast("double")
    pair = lambda k: F.col("pairwise_metrics").getField(f"{k}_ratio").cast("double")
    label = F.when(F.col("temperature") == "default", F.col("run")).otherwise(F.concat("run", F.lit(" ("), "temperature", F.lit(")")))
    parseable = F.concat_ws("/", *(F.coalesce(F.col(n).cast("string"), F.lit("0")) if n in documents.columns else F.lit("0") for n in ("parseable_samples", "total_samples")))
    return documents.select(
        "run", "temperature", label.alias("Run"), parseable.alias("Parseable"), c("standard_metrics.accuracy").alias("Acc"), c("standard_metrics.f1_score").alias("F1"), *(pair(k).alias(k) for k in ("P-C", "P-V", "P-B", "P-R")), c("line_localization_metrics.avg_f1").alias("Loc F1")
    )


def by_series(runs: DataFrame, metrics: tuple[str, ...] = METRICS, run: str = "run", temperature: str = "temperature") -> DataFrame:
    """One row for each series and temperature: runs, and of each metric mean (0 without values), largest, least and spread."""
    values = []
    for m in metrics:
        v = F.col(f"`{m}`")
        values += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{m}_mean"), F.max(v).alias(f"{m}_max"), F.min(v).alias(f"{m}_min"), (F.max(v) - F.min(v)).alias(f"{m}_max_spread")]
    return runs.groupBy(series_name(F.col(run)).alias("series"), temperature).agg(F.count("*").alias("run_count"), F.array_sort(F.collect_list(run)).alias("runs"), *values)


def sort_value(column: Column) -> Column:
    """A column's number: of texts such as 3/5 the numerator; what has none is 0."""
    return F.coalesce(F.split_part(column.cast("string"), F.lit("/"), F.lit(1)).try_cast("double"), F.lit(0.0))


def table(runs: DataFrame, sort_by: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    if sort_by:
        key = sort_value(F.col(f"`{sort_by}`"))
        runs = runs.orderBy(key.desc() if descending else key.asc(), runs.columns[0])
    return runs.limit(limit) if limit else runs


def rollouts_with_rewards(rollouts: DataFrame, output: str = "output", truth: str = "gts", ignore_patched_truth: bool = False) -> DataFrame:
    """Trainer rollouts with is_vulnerable, n_truth, n_lines (given in answers that parse), and new_score by the graded reward."""
    from ..functions.responses import aliased_lines, parse, tolerant_truth
    from ..functions.reward import graded_reward

    rows = rollouts.withColumn("_t", tolerant_truth(F.col(truth))).withColumn("_p", parse(F.col(output)))
    new = graded_reward(F.col("_p.classification"), F.col("_p.lines"), F.col("_p.status"), F.col("_t.is_vulnerable"), F.col("_t.ground_truth_lines"), ignore_patched_truth)
    given = F.when(F.col("_p.status") == "VALID", F.size(aliased_lines(F.col(output)))).otherwise(0)
    return rows.withColumns({"is_vulnerable": F.col("_t.is_vulnerable"), "n_truth": F.size("_t.ground_truth_lines"), "n_lines": given, "new_score": new}).drop("_t", "_p")


def rollout_scores(scored: DataFrame, over: str = "n_lines") -> DataFrame:
    """Means and deviation of old and new rewards by label and in total, and how often more lines than the 99th percentile are given."""
    edge = with_percentiles(scored.sparkSession.range(1), scored, over, {"_p99": 0.99}, []).select("_p99")
    rows = scored.join(F.broadcast(edge))  # one row
    return rows.groupingSets([["is_vulnerable"], []], "is_vulnerable").agg(
        F.grouping("is_vulnerable").cast("boolean").alias("is_total"), F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("new_score").alias("mean_new_score"), F.stddev_pop("score").alias("std_score"),
        F.stddev_pop("new_score").alias("std_new_score"), F.avg((F.col(over) > F.col("_p99")).cast("double")).alias("spray_rate"),
    )

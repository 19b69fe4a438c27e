"""Rewards and line metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .responses import decode_truth, parse


def numbers_or_none(items: Column) -> Column:
    return F.coalesce(items.cast("array<bigint>"), F.array().cast("array<bigint>"))


def line_accuracy(predicted: Column, truth: Column) -> Column:
    """Distinct true lines that are predicted, per entry of the truth; with no truth, 1 if nothing is predicted."""
    p, t = numbers_or_none(predicted), numbers_or_none(truth)
    return F.when(F.size(t) == 0, (F.size(p) == 0).cast("double")).otherwise(F.size(F.array_intersect(p, t)) / F.size(t))


def reward(classification: Column, predicted: Column, status: Column, is_vulnerable: Column, truth: Column, spray_threshold: int = 0) -> Column:
    """0, 0.1, 0.3, 0.75 or 1. Over the spray threshold (0: none) predicted lines count for nothing."""
    right = classification == F.when(is_vulnerable, "VULNERABLE").otherwise("NOT_VULNERABLE")
    accuracy = line_accuracy(predicted, truth)
    if spray_threshold > 0:
        accuracy = F.when(F.size(numbers_or_none(predicted)) > spray_threshold, 0.0).otherwise(accuracy)
    return (
        F.when(~F.coalesce(status.isin("VALID", "INVALID_CLASSIFICATION"), F.lit(False)), 0.0).when(classification.isNull(), 0.1)
        .when(right & (accuracy >= 0.5), 1.0).when(right, 0.75).when(accuracy > 0, 0.3).otherwise(0.1)
    )


def graded_reward(classification: Column, predicted: Column, status: Column, is_vulnerable: Column, truth: Column, ignore_patched_truth: bool = False) -> Column:
    """The experimental reward: up to half a point more for lines, in full at three quarters of them."""
    t = numbers_or_none(truth)
    if ignore_patched_truth:
        t = F.when(is_vulnerable, t).otherwise(F.array().cast("array<bigint>"))
    p = numbers_or_none(predicted)
    share = F.size(F.array_intersect(p, t)) / F.greatest(F.size(t), F.lit(1))
    right = (classification == "VULNERABLE") == is_vulnerable
    lines = F.when(F.size(t) == 0, F.when(F.size(p) == 0, 1.25).otherwise(0.75)).otherwise(0.75 + 0.5 * F.least(F.lit(1.0), share / 0.75))
    return F.when(~F.coalesce(status.isin("VALID", "INVALID_CLASSIFICATION"), F.lit(False)), 0.0).when(classification.isNull(), 0.15).when(right, lines).otherwise(0.15)


def score_completions(df, completion: str = "completion", is_vulnerable: str | None = None, truth: str | None = None, ground_truth: str | None = None, spray_threshold: int = 0):
    """df with `parsed` and `reward`; truth comes as columns, or as JSON text in `ground_truth`; missing ones are (true, [])."""
    if ground_truth:
        told = decode_truth(F.col(ground_truth))
        label, lines = told["is_vulnerable"], told["ground_truth_lines"]
    else:
        label = F.coalesce(F.col(is_vulnerable), F.lit(True)) if is_vulnerable else F.lit(True)
        lines = F.col(truth) if truth else F.array().cast("array<int>")
    parsed = df.withColumn("parsed", parse(F.col(completion)))
    return parsed.withColumn("reward", reward(F.col("parsed.classification"), F.col("parsed.lines"), F.col("parsed.status"), label, lines, spray_threshold))


def line_scores(truth: Column, predicted: Column) -> Column:
    """struct(precision, recall, f1) of sets of lines; null without truth, zeros without prediction."""
    t, p = F.array_distinct(numbers_or_none(truth)), F.array_distinct(numbers_or_none(predicted))
    hits = F.size(F.array_intersect(t, p))
    precision = F.when(F.size(p) == 0, 0.0).otherwise(hits / F.greatest(F.size(p), F.lit(1)))
    recall = F.when(F.size(p) == 0, 0.0).otherwise(hits / F.greatest(F.size(t), F.lit(1)))
    f1 = F.when(hits == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return F.when(F.size(t) > 0, F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1")))


def registered_reward(spark, path: str, function: str, name: str = "custom_reward"):
    """A reward function of a Python file, f(data_source, solution, ground_truth, extra_info) -> number, registered for SQL and returned.

    The file's text travels with the task, so workers needn't have it.
    """
    from pyspark.sql import types as T

    with open(path, encoding="utf-8") as f:
        source = f.read()
    held: dict = {}

    def call(data_source, solution, ground_truth, extra_info):
        if function not in held:
            space: dict = {"__name__": "custom_reward"}
            exec(compile(source, path, "exec"), space)  # noqa: S102  the user's own function
            held.update(space)
        return float(held[function](data_source, solution, ground_truth, extra_info))

    return spark.udf.register(name, call, T.DoubleType())

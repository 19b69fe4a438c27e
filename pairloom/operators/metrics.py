"""Classification, pair-wise and line metrics of parsed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.responses import for_metrics, parse, yes_no
from ..functions.reward import line_scores

OUTCOMES = ("P-C", "P-V", "P-B", "P-R")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification(target: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates of rows with a prediction; the positive class is 1, and what can't be divided is 0."""
    usable = target.isNotNull() & predicted.isNotNull()
    tp, hit, said, true = (F.count_if(usable & c) for c in ((target == 1) & (predicted == 1), target == predicted, predicted == 1, target == 1))
    precision, recall = ratio(tp, said), ratio(tp, true)
    return {"accuracy": ratio(hit, F.count_if(usable)), "precision": precision, "recall": recall, "f1_score": ratio(2 * tp, said + true)}


def outcome(predicted_vulnerable: Column, predicted_patched: Column) -> Column:
    """The class of a pair by what was predicted of its two sides."""
    v, p = predicted_vulnerable == 1, predicted_patched == 1
    return F.when(v & ~p, "P-C").when(v & p, "P-V").when(~v & ~p, "P-B").when(~v & p, "P-R")


def pair_outcomes(rows: DataFrame, by: list[str], pair: str, is_vulnerable: str, predicted: str) -> DataFrame:
    """(by..., pair, outcome) of pairs with exactly one predicted row of each side."""
    v = F.col(is_vulnerable)
    known = rows.filter(F.col(predicted).isNotNull())
    sides = known.groupBy(*by, pair).agg(F.count_if(v).alias("_v"), F.count_if(~v).alias("_p"), F.max(F.when(v, F.col(predicted))).alias("_pv"), F.max(F.when(~v, F.col(predicted))).alias("_pp"))
    return sides.filter("_v = 1 and _p = 1").select(*by, pair, outcome(F.col("_pv"), F.col("_pp")).alias("outcome"))


def predictions(responses: DataFrame) -> DataFrame:
    """Responses with predicted (1, 0 or null) and predicted_lines, by the rules of their prompt type."""
    parsed = responses.withColumn("_parsed", parse(F.col("response")))
    said, lines = for_metrics(F.col("_parsed"))
    training = F.col("prompt_type") == "training"
    return parsed.withColumn("predicted", F.when(training, said).otherwise(yes_no(F.col("response")))).withColumn("predicted_lines", F.when(training, lines)).drop("_parsed")


def metrics(responses: DataFrame, by: tuple[str, ...] = ("prompt_type",), subset: str = "combined") -> DataFrame:
    """One row for each prompt type: the metrics document of a subset."""
    rows = predictions(responses).withColumn("pair_id", F.coalesce("pair_id", "commit_id"))
    numbers = F.transform("ground_truth_lines", lambda x: x["line_no"])
    eligible = (F.col("prompt_type") == "training") & F.col("is_vulnerable") & (F.col("predicted") == 1)
    rows = rows.withColumn("_line", F.when(eligible, line_scores(numbers, F.col("predicted_lines"))))
    standard = rows.groupBy(*by).agg(
        F.count("*").alias("total_samples"), F.count("predicted").alias("parseable_samples"), F.count_if(F.col("predicted").isNull()).alias("unparseable_samples"),
        F.struct(*(c.alias(k) for k, c in classification(F.col("target"), F.col("predicted")).items())).alias("standard_metrics"),
        F.struct(F.count("_line").alias("num_samples"), *(F.avg(f"_line.{k}").alias(f"avg_{k}") for k in ("precision", "recall", "f1"))).alias("_lines"),
    )
    counts = pair_outcomes(rows, list(by), "pair_id", "is_vulnerable", "predicted").groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == k).alias(k) for k in OUTCOMES))
    joined = standard.join(counts, list(by), "left")
    n = F.coalesce("n", F.lit(0))
    fields = [n.alias("total_valid_pairs")]
    for k in OUTCOMES:
        c = F.coalesce(F.col(f"`{k}`"), F.lit(0))
        fields += [c.alias(f"{k}_count"), ratio(c, n).alias(f"{k}_ratio")]
    return joined.select(F.lit(subset).alias("subset"), *by, "total_samples", "parseable_samples", "unparseable_samples", "standard_metrics", F.struct(*fields).alias("pairwise_metrics"), F.when(F.col("prompt_type") == "training", F.col("_lines")).alias("line_localization_metrics"))


def of_prompt_type(responses: DataFrame, wanted: str, column: str = "prompt_type") -> DataFrame:
    """Responses of one prompt type; those that name none are of the type unknown."""
    return responses.filter(F.coalesce(F.col(column), F.lit("unknown")) == wanted)


def reports(responses: DataFrame, first: str = "primevul_test") -> DataFrame:
    """The documents of one split and of all together."""
    return metrics(responses.filter(F.col("split") == first), subset=first).unionByName(metrics(responses))


def status_distribution(parsed: DataFrame, by: tuple[str, ...] = (), status: str = "status") -> DataFrame:
    """(by..., status, n, percent), the most frequent first."""
    from pyspark.sql import Window

    counts = parsed.groupBy(*by, status).agg(F.count("*").alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))), 2)
    return counts.withColumn("percent", share).orderBy(*by, F.desc("n"), status)


def status_samples(parsed: DataFrame, text: str, ordinal: str, n: int = 3, width: int = 200) -> DataFrame:
    """The first n rows of each status with the head and the tail of their text."""
    from .ordinals import first_by_category

    return first_by_category(parsed, ["status"], n, ordinal).select("status", ordinal, F.left(text, F.lit(width)).alias("head"), F.right(text, F.lit(width)).alias("tail"))

"""The dataset plans: merged pairs, evaluation pairs, SFT rows, RL rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import training_prompt
from ..functions.responses import THINK_END, encode_truth
from ..functions.text import line_numbers
from ..operators.dedup import deduplicate
from ..operators.lookups import looked_up, unique_index, with_fallback
from ..operators.ordinals import tail_split, with_ordinal
from ..operators.pairing import without_no_ops
from ..operators.pooling import enrich, pool
from ..schemas import EVAL_SPLITS, PAIR_COLUMNS
from ..operators.stats import cap_threshold


def in_order(*frames: DataFrame) -> DataFrame:
    """Sources one after the other, with the ordinal that order-dependent steps use."""
    whole = None
    for i, frame in enumerate(frames):
        part = frame.select(*PAIR_COLUMNS, *(c for c in ("split",) if c in frame.columns)).withColumn("_source", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    return with_ordinal(whole, "_source", "source_row_idx", "pair_id", "vuln_hash").drop("_source")


def merged(*sources: DataFrame, dedup: bool = True, carry_swap: bool = False) -> DataFrame:
    """Pairs of all sources: pooled metadata, one row for each function variant, gaps filled, no-op pairs left out."""
    pairs = in_order(*sources)
    pooled = pool(pairs)
    kept = deduplicate(pairs, carry_swap=carry_swap) if dedup else pairs
    return without_no_ops(enrich(kept, pooled)).drop("ordinal")


def evaluation(test: DataFrame, validation: DataFrame, other: DataFrame) -> DataFrame:
    """Evaluation pairs with their split, deduplicated across splits."""
    parts = [df.withColumn("split", F.lit(name)) for df, name in zip((test, validation, other), EVAL_SPLITS, strict=True)]
    pairs = in_order(*parts)
    return without_no_ops(enrich(deduplicate(pairs), pool(pairs))).drop("ordinal")


def sft_reasons(teacher: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Teacher rows with the first reason against each, or none; with pairs, prompts are made anew without hints."""
    response = F.coalesce("generated_response", F.lit(""))
    reason = F.when((response == "") | response.startswith("ERROR_"), "no_response").when(~response.contains(THINK_END) | F.col("parsed_classification").isNull(), "incomplete")
    if pairs is None:
        return teacher.withColumn("reason", reason)
    known = looked_up(teacher, unique_index(pairs, "pair_id"), "pair_id", ["vuln_func", "patched_func"])
    code = F.when(F.col("is_vulnerable"), F.col("vuln_func")).otherwise(F.col("patched_func"))
    return known.withColumn("reason", reason.when(~F.col("is_found"), "no_pair")).withColumn("prompt", training_prompt(code)).drop("vuln_func", "patched_func", "is_found")


def sft_rows(teacher: DataFrame, pairs: DataFrame | None = None, most: int | None = None, ratio: float = 0.05) -> DataFrame:
    """SFT rows with is_validation for the last part in the order of pair_id and label."""
    rows = sft_reasons(teacher, pairs).filter("reason is null")
    rows = rows.select("prompt", F.col("generated_response").alias("response"), "is_vulnerable", "pair_id", "commit_id", F.coalesce("ground_truth_lines", F.array().cast("array<int>")).alias("ground_truth_lines"))
    order = ("pair_id", F.col("is_vulnerable").desc(), "response")
    return tail_split(rows.orderBy(*order).limit(most) if most else rows, *order, ratio=ratio)


def rl_rows(
    samples: DataFrame, pairs: DataFrame | None = None, score_patched: bool = False, most_lines: int | None = None, percentile: float | None = None, multiplier: float = 1.0, ratio: float = 0.05,
    validation: DataFrame | None = None,
) -> DataFrame:
    """RL rows with is_validation. Truth of patched rows is empty unless it is to be scored; lists over the cap are emptied.

    With `validation`, samples of a split that is given, all of `samples` are for training; the cap leaves validation alone.
    """
    if validation is not None:
        how = {"pairs": pairs, "score_patched": score_patched}
        train = rl_rows(samples, most_lines=most_lines, percentile=percentile, multiplier=multiplier, ratio=0.0, **how)
        return train.unionByName(rl_rows(validation, ratio=0.0, **how).withColumn("is_validation", F.lit(True)))
    if most_lines is not None and percentile is not None:
        raise ValueError("a cap is either given or taken from a percentile")
    label = F.coalesce("is_vulnerable", F.lit(True))
    rows = samples.withColumn("is_vulnerable", label).withColumn("ground_truth_lines", F.coalesce("ground_truth_lines", F.array().cast("array<int>")))
    if not score_patched:
        rows = rows.withColumn("ground_truth_lines", F.when(F.col("is_vulnerable"), F.col("ground_truth_lines")).otherwise(F.array().cast("array<int>")))
    elif pairs is not None:
        index = unique_index(pairs, "pair_id").withColumn("_added", line_numbers(F.col("added_lines")))
        rows = with_fallback(rows, index, "pair_id", "ground_truth_lines", "_added", ~F.col("is_vulnerable"))
    rows = rows.withColumn("_n", F.size("ground_truth_lines"))
    if percentile is not None:
        # patched rows count only where they are scored; without lines they are zeros, which never count
        base = rows if score_patched else rows.filter("is_vulnerable")
        rows = rows.join(F.broadcast(cap_threshold(base, "_n", percentile, multiplier)))  # one row
    else:
        rows = rows.withColumn("threshold", F.lit(most_lines).cast("long"))
    over = F.coalesce(F.col("_n") > F.col("threshold"), F.lit(False))
    rows = rows.withColumn("ground_truth_lines", F.when(over, F.array().cast("array<int>")).otherwise(F.col("ground_truth_lines")))
    order = ("pair_id", F.col("is_vulnerable").desc(), "prompt")
    numbered = tail_split(with_ordinal(rows, *order, name="idx"), "idx", ratio=ratio)
    return numbered.select(
        F.lit("vulnerability_detection").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"), F.lit("security").alias("ability"),
        F.struct(F.lit("rule").alias("style"), encode_truth(F.col("is_vulnerable"), F.col("ground_truth_lines")).alias("ground_truth")).alias("reward_model"),
        F.struct("pair_id", "commit_id", F.col("idx").cast("long").alias("idx"), "is_vulnerable").alias("extra_info"), "is_validation",
    )

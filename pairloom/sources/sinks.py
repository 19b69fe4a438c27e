"""Writers of datasets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .named import write_named


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def nested_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def metric_files(metrics: DataFrame, path: str) -> None:
    """One document for each subset and prompt type: the file path/metrics_{subset}_{prompt}.json."""
    name = F.concat(F.lit("metrics_"), "subset", F.lit("_"), "prompt_type", F.lit(".json"))
    write_named(metrics.select(name.alias("name"), F.to_json(F.struct("*")).alias("content")), path)


def train_and_validation(rows: DataFrame, path: str, in_validation: str = "is_validation") -> None:
    for name, wanted in (("train", False), ("val", True)):
        rows.filter(F.col(in_validation) == wanted).drop(in_validation).write.mode("overwrite").json(f"{path}_{name}.jsonl")


def not_valid(parsed: DataFrame, also_skipped: bool = True) -> DataFrame:
    """Rows whose status isn't VALID, for a separate look; skipped ones on demand."""
    return parsed.filter(F.col("status") != "VALID") if also_skipped else parsed.filter(~F.col("status").isin("VALID", "SKIPPED"))


def write_not_valid(parsed: DataFrame, path: str, columns: tuple[str, ...] = (), also_skipped: bool = True, line: str = "_line_number") -> None:
    """Rows whose status isn't VALID as JSON lines: whole, with _parse_status, _parse_classification, _parse_lines and
    their line number, or only `columns` and the status."""
    rows = not_valid(parsed, also_skipped)
    about = [F.col("status").alias("_parse_status"), F.col("classification").alias("_parse_classification"), F.col("lines").alias("_parse_lines"), F.col(line).alias("_line_number")]
    rest = [c for c in parsed.columns if c not in ("status", "classification", "lines", line)]
    json_lines(rows.select(*columns, "status") if columns else rows.select(*rest, *about), path)


def completion_log(scored: DataFrame, path: str, step: int, order: tuple[str, ...] = ("idx",), completion: str = "completion") -> None:
    """Appends one call's scored completions to a log: step, idx, timestamp, label, truth, length, text and reward."""
    from ..operators.ordinals import with_ordinal

    numbered = with_ordinal(scored.withColumn("_text", F.coalesce(completion, F.lit(""))), *order, name="_idx")
    rows = numbered.select(
        F.lit(step).cast("long").alias("step"), F.col("_idx").alias("idx"), F.current_timestamp().cast("timestamp_ntz").alias("timestamp"), "is_vulnerable", "ground_truth_lines",
        F.length("_text").cast("long").alias("completion_length"), F.col(completion).alias("completion"), "reward",
    )
    json_lines(rows, path, append=True)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small report as a markdown table; one of more than `most` rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [" | ".join(df.columns), " | ".join("-" for _ in df.columns)] + [" | ".join(map(cell, r)) for r in rows]
    return "\n".join(f"| {line} |" for line in lines)

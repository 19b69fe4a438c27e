"""Command line: python -m pairloom.cli COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import audit, metrics, pairing, rollout, runs
from .plans import datasets
from .sources import readers, sinks


def merge(spark, a):
    one = readers.json_lines(spark, a.source_a, schemas.SOURCE_A).withColumn("ordinal", F.monotonically_increasing_id())
    parts = [pairing.pairs_a(one), pairing.pairs_b(readers.parquet_files(spark, a.source_b)), pairing.pairs_c(readers.parquet_files(spark, a.source_c)).drop("reindex_method", "added_method")]
    sinks.json_lines(datasets.merged(*parts, dedup=not a.skip_dedup), a.output)


def evaluation(spark, a):
    test, validation = (pairing.pairs_a(readers.json_lines(spark, p, schemas.SOURCE_A).withColumn("ordinal", F.monotonically_increasing_id())) for p in (a.test, a.validation))
    sinks.json_lines(datasets.evaluation(test, validation, pairing.pairs_b(readers.parquet_files(spark, a.other))), a.output)


def verify(spark, a):
    found = audit.verify(readers.json_lines(spark, a.input, schemas.PAIR))
    print(found)
    return int(any(found.values()))


def sft(spark, a):
    pairs = None if a.include_hints else readers.json_lines(spark, a.merged, schemas.PAIR)
    rows = datasets.sft_rows(readers.json_lines_lenient(spark, a.input, schemas.TEACHER), pairs, a.max_samples)
    sinks.train_and_validation(rows, a.output)


def rl(spark, a):
    pairs = readers.json_lines(spark, a.merged, schemas.PAIR) if a.merged else None
    rows = datasets.rl_rows(readers.json_lines(spark, a.input, schemas.TEACHER), pairs, a.score_patched_lines, a.max_gt_lines, a.gt_percentile_cap, a.gt_percentile_multiplier, a.val_ratio)
    for name, wanted in (("train", False), ("val", True)):
        sinks.nested_parquet(rows.filter(F.col("is_validation") == wanted).drop("is_validation"), f"{a.output}/{name}.parquet")


def score(spark, a):
    sinks.metric_files(metrics.reports(readers.json_lines(spark, a.input, schemas.RESPONSE)), a.output)


def compare(spark, a):
    flat = runs.flattened(readers.metric_documents(spark, a.base_dir, name_filter=a.filter))
    shown = runs.by_series(flat) if a.aggregate else flat
    print(sinks.markdown_table(runs.table(shown, a.sort, a.desc, a.limit)))


def rollouts(spark, a):
    log = readers.json_lines_lenient(spark, a.completions, schemas.COMPLETION).filter("timestamp is not null").withColumn("run", F.lit(a.label))
    keys = ("run", "timestamp", "call_num")
    print(sinks.markdown_table(rollout.ordinal_buckets(log, *keys, ("completion_length", "reward")).orderBy("bucket")))
    print(sinks.markdown_table(rollout.batch_summary(rollout.batch_facts(log, *keys, "completion_length", "reward"), "run")))


COMMANDS = {
    merge: (["source_a", "source_b", "source_c", "output"], {"--skip_dedup": {"action": "store_true"}}),
    evaluation: (["test", "validation", "other", "output"], {}),
    verify: (["input"], {}),
    sft: (["input", "output"], {"--merged": {}, "--include_hints": {"action": "store_true"}, "--max_samples": {"type": int}}),
    rl: (["input", "output"], {"--merged": {}, "--score_patched_lines": {"action": "store_true"}, "--val_ratio": {"type": float, "default": 0.05}, "--max_gt_lines": {"type": int}, "--gt_percentile_cap": {"type": float}, "--gt_percentile_multiplier": {"type": float, "default": 1.0}}),
    score: (["input", "output"], {}),
    compare: (["base_dir"], {"--filter": {}, "--sort": {}, "--desc": {"action": "store_true"}, "--limit": {"type": int}, "--aggregate": {"action": "store_true"}}),
    rollouts: (["completions"], {"--label": {"default": "run"}}),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pairloom")
    commands = parser.add_subparsers(required=True)
    for run, (needed, more) in COMMANDS.items():
        command = commands.add_parser(run.__name__)
        for name in needed:
            command.add_argument(name)
        for name, how in more.items():
            command.add_argument(name, **how)
        command.set_defaults(run=run)
    parsed = parser.parse_args(argv)
    return parsed.run(spark or SparkSession.builder.appName("pairloom").getOrCreate(), parsed) or 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Model calls over partitions: a provider answers requests, errors become rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import for_reward, parse
from ..operators.lookups import not_done

TEACHER_ERROR, EVAL_ERROR = "ERROR_SGLANG_CALL: ", "ERROR: "


class Provider(Protocol):
    """What answers prompts. It is pickled to the workers, so it opens connections when first called."""

    def complete(self, prompt: str, max_tokens: int) -> str: ...


class FixedProvider:
    """Answers every prompt by a function, offline."""

    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompt: str, max_tokens: int) -> str:
        return self.answer(prompt, max_tokens)


def completed(requests: DataFrame, provider: Provider, threads: int = 8, error: str = TEACHER_ERROR, output: str = "generated_response") -> DataFrame:
    """requests (prompt, api_max_tokens) with the answers; a failed call's answer is the error's text. Rows go in batches, `threads` at a time."""
    schema = requests.withColumn(output, F.lit(None).cast("string")).schema
    columns = [*requests.columns, output]

    def ask(row) -> str:
        try:
            return provider.complete(row[0], int(row[1]))
        except Exception as e:  # a call that fails is a row of its own
            return f"{error}{e}"

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                answers = list(pool.map(ask, zip(batch["prompt"], batch["api_max_tokens"], strict=True)))
                batch[output] = pd.Series(answers, dtype="object", index=batch.index)
                yield batch[columns]

    return requests.mapInPandas(run, schema)


def teacher_rows(requests: DataFrame, provider: Provider, threads: int = 8, done: DataFrame | None = None) -> DataFrame:
    """Teacher rows of the requests that aren't in `done` yet, by commit, hash and label."""
    key = ["commit_id", "vuln_hash", "is_vulnerable"]
    rows = completed(not_done(requests, done, key) if done is not None else requests, provider, threads)
    classification, lines = for_reward(F.col("_parsed"))
    rows = rows.withColumn("_parsed", parse(F.col("generated_response")))
    return rows.select("pair_id", "commit_id", "func_name", "vuln_hash", "source", "is_vulnerable", "code", "prompt", "generated_response", "ground_truth_lines", classification.alias("parsed_classification"), lines.alias("parsed_important_lines"))


def eval_rows(requests: DataFrame, provider: Provider, threads: int = 8) -> DataFrame:
    """Evaluation responses; skipped rows keep theirs."""
    skipped = requests.filter("response is not null")
    asked = completed(requests.filter("response is null").drop("response").withColumn("api_max_tokens", F.lit(4096)), provider, threads, EVAL_ERROR, "response")
    return skipped.unionByName(asked.drop("api_max_tokens").select(*requests.columns))

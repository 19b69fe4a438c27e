"""Audits of pairs and of the RL dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import decode_truth
from ..functions.text import code_in_prompt, last_line_number, lines, mismatched_cves, prompt_text, strip

TINY = 3


def line_issues(pairs: DataFrame) -> DataFrame:
    """A row for each changed line that is out of bounds, or whose text is neither part of the line there nor holds it."""
    sides = F.array(
        F.struct(F.lit("deleted_lines").alias("field"), F.col("deleted_lines").alias("changes"), F.col("vuln_func").alias("code")),
        F.struct(F.lit("added_lines").alias("field"), F.col("added_lines").alias("changes"), F.col("patched_func").alias("code")),
    )
    each = pairs.select("pair_id", "source", "commit_id", F.inline(sides)).filter(F.coalesce(F.col("code"), F.lit("")) != "")
    each = each.withColumn("of", lines(F.col("code"))).select("pair_id", "source", "commit_id", "field", "of", F.explode("changes").alias("c"))
    number, expected = F.coalesce("c.line_no", F.lit(0)), strip(F.coalesce("c.text", F.lit("")))
    actual = strip(F.coalesce(F.get("of", number - 1), F.lit("")))
    outside = (number > F.size("of")) | (number < 1)
    astray = (expected != "") & (actual != expected) & ~actual.contains(expected) & ~expected.contains(actual)
    kind = F.when(outside, "oob").when(astray, "misindexed")
    found = each.select("pair_id", "source", "commit_id", "field", number.alias("line_no"), F.size("of").alias("func_lines"), F.left(expected, F.lit(80)).alias("expected"), F.when(~outside, F.left(actual, F.lit(80))).alias("actual"), kind.alias("type"))
    return found.filter("type is not null")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("source", "type").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"))


def pair_report(pairs: DataFrame) -> DataFrame:
    """One row of counts over all pairs."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    some = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    return pairs.agg(
        F.count("*").alias("total"), F.count_if(F.col("vuln_func") == F.col("patched_func")).alias("identical"), F.count_if(~some("deleted_lines")).alias("no_deleted_lines"),
        F.count_if(mismatched_cves(F.col("cve"), F.col("cve_desc"))).alias("cve_description_mismatch"), F.count_if(some("cve")).alias("with_cve"), F.count_if(some("cwe")).alias("with_cwe"),
        F.count_if(filled("cve_desc")).alias("with_description"), F.count_if(filled("commit_message")).alias("with_message"), F.count_if(filled("project")).alias("with_project"),
        F.count_if(filled("func_name")).alias("with_func_name"), F.count_if(filled("filepath") & (F.col("filepath") != "None")).alias("with_filepath"),
    )


def verify(pairs: DataFrame) -> dict[str, int]:
    """Counts of line issues and of duplicate keys; the data are sound if both are 0."""
    from .lookups import duplicate_keys

    return {"issues": line_issues(pairs).count(), "duplicates": duplicate_keys(pairs, F.lower("commit_id").alias("commit"), "func_name", "vuln_hash").count()}


def rl_flags(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """RL rows with flags for what is wrong. Texts of lines are looked up by pair, as one commit can have several functions."""
    truth = decode_truth(F.col("reward_model.ground_truth"))
    prompt = prompt_text(F.col("prompt"))
    texts = pairs.select(F.col("pair_id").alias("_pair"), F.col("source"), F.col("deleted_lines").alias("_lines"))
    made = rows.withColumn("_truth", truth).withColumn("_prompt", prompt).withColumn("_code", code_in_prompt(F.col("_prompt")))
    made = made.join(texts, F.col("extra_info.pair_id") == F.col("_pair"), "left")
    numbers, count = F.col("_truth.ground_truth_lines"), F.when(F.col("_code") != "", last_line_number(F.col("_code"))).otherwise(0)
    body = F.transform(F.split("_code", "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*[0-9]+:\s?", "")))
    wrong = F.exists(
        F.filter(F.coalesce("_lines", F.array()), lambda c: F.array_contains(numbers, c["line_no"]) & (c["line_no"] <= F.size("_body"))),
        lambda c: (F.get("_body", c["line_no"] - 1) != strip(c["text"])) & ~F.get("_body", c["line_no"] - 1).contains(strip(c["text"])) & ~strip(c["text"]).contains(F.get("_body", c["line_no"] - 1)),
    )
    vulnerable = F.col("_truth.is_vulnerable")
    made = made.withColumn("_body", body).withColumn("code_lines", count)
    return made.select(
        F.col("extra_info.pair_id").alias("pair_id"), F.col("extra_info.idx").alias("idx"), F.coalesce("source", F.lit("Unknown")).alias("source"), vulnerable.alias("is_vulnerable"), "code_lines",
        ((F.col("code_lines") > 0) & F.exists(numbers, lambda x: x > F.col("code_lines"))).alias("oob"), ((F.col("code_lines") > 0) & wrong).alias("misindexed"),
        (vulnerable & (F.size(numbers) == 0)).alias("vulnerable_without_lines"), ((F.col("code_lines") > 0) & (F.col("code_lines") <= TINY)).alias("tiny"),
        (F.col("_prompt").contains("This code contains a security vulnerability") & ~vulnerable).alias("hint_conflict"), (F.col("_prompt").contains("patched (non-vulnerable)") & vulnerable).alias("patched_hint_conflict"),
    )


def rl_report(flags: DataFrame, *by: str) -> DataFrame:
    names = ("oob", "misindexed", "vulnerable_without_lines", "tiny", "hint_conflict", "patched_hint_conflict")
    return flags.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(n)).alias(n) for n in names))

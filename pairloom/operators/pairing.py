"""From raw sources to unified pairs."""

from __future__ import annotations

import pandas as pd
from difflib import SequenceMatcher
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.diff import changed_lines, with_repair
from ..functions.text import clean_list, code_hash, commit_link_parts, encoded_changes, function_name, pair_id, paired_changes, present, same_but_for_trailing_blanks, strip
from ..schemas import PAIR_COLUMNS, A, B, C


def greedy_matches(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Each old text in turn takes the most similar new text that is left, the first among equals."""
    left, found = dict(enumerate(new)), []
    for i, text in enumerate(old):
        best, highest = None, -1.0
        for j, other in left.items():
            if text == other:
                best = j  # nothing is more similar, and earlier ones that are equal were taken first
                break
            # both bounds are never under the ratio, and cost less
            matcher = SequenceMatcher(None, text, other)
            if matcher.real_quick_ratio() > highest and matcher.quick_ratio() > highest and (ratio := matcher.ratio()) > highest:
                best, highest = j, ratio
        if best is not None:
            del left[best]
            found.append((i, best))
    return found


def both_labels(rows: DataFrame, by: str = "commit_id", target: str = "target") -> DataFrame:
    """Rows of groups with both labels."""
    kinds = rows.groupBy(by).agg(F.max((F.col(target) == 1).cast("int")).alias("_one"), F.max((F.col(target) == 0).cast("int")).alias("_zero")).filter("_one = 1 and _zero = 1")
    return rows.join(kinds.select(by), by, "left_semi")


def exactly_one_each(rows: DataFrame, by: str = "commit_id", target: str = "target") -> DataFrame:
    """Rows of groups that are one row of each label."""
    kinds = rows.groupBy(by).agg(F.count("*").alias("_n"), F.count_if(F.col(target) == 1).alias("_one"), F.count_if(F.col(target) == 0).alias("_zero")).filter("_n = 2 and _one = 1 and _zero = 1")
    return rows.join(kinds.select(by), by, "left_semi")


def similarity_pairs(rows: DataFrame, key: list[str], text: str, label: str, ordinal: str) -> DataFrame:
    """(key..., old, new): ordinals of the rows labelled 1 and 0 that greedy_matches pairs in each group, in order."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def match(key_values, group):
        group = group.sort_values(ordinal, kind="stable")
        old, new = group[group[label] == 1], group[group[label] == 0]
        found = greedy_matches(old[text].tolist(), new[text].tolist())
        made = pd.DataFrame({"old": [old[ordinal].iloc[i] for i, _ in found], "new": [new[ordinal].iloc[j] for _, j in found]}, dtype="int64")
        for name, value in zip(key, key_values, strict=True):
            made[name] = value
        return made[[*key, "old", "new"]]

    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", old long, new long"
    return rows.select(*key, text, label, ordinal).groupBy(*key).applyInPandas(match, schema)


def pairs_a(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Source A, one function a row: functions of one commit and name are paired by similarity. `ordinal` is the order of the file."""
    named = both_labels(rows).withColumn("func_name", function_name(F.col("func")))
    matched = similarity_pairs(named, ["commit_id", "func_name"], "func", "target", ordinal)
    old, new = named.alias("o"), named.select(F.col("func").alias("patched_func"), F.col(ordinal).alias("_new")).alias("n")
    both = matched.select("old", "new").join(old, F.col("old") == F.col(f"o.{ordinal}")).join(new, F.col("new") == F.col("n._new"))
    cwe = F.coalesce(F.from_json("cwe", "array<string>"), F.array("cwe"))
    diff = changed_lines(F.col("func"), F.col("patched_func"))
    made = both.withColumn("_diff", diff).withColumns(
        {
            "source": F.lit(A), "filepath": F.col("file_name"), "vuln_hash": code_hash(F.col("func")), "vuln_func": F.col("func"), "cve": clean_list(F.array("cve")), "cwe": clean_list(cwe),
            "commit_message": F.when(present(F.col("commit_message")).isNotNull(), F.col("commit_message")).otherwise(""), "deleted_lines": F.col("_diff.deleted"), "added_lines": F.col("_diff.added"), "source_row_idx": F.col("idx"),
        }
    )
    return made.withColumn("pair_id", pair_id(F.lit(A), *map(F.col, ("project", "commit_id", "func_name", "vuln_hash")))).select(*PAIR_COLUMNS)


def pairs_b(rows: DataFrame) -> DataFrame:
    """Source B, one pair a row."""
    project, commit, url = commit_link_parts(F.col("commit_link"))
    made = rows.withColumns(
        {
            "source": F.lit(B), "project": project, "commit_id": commit, "project_url": url, "filepath": F.col("file_name"), "vuln_func": F.col("func_src_before"), "patched_func": F.col("func_src_after"),
            "vuln_hash": code_hash(F.col("func_src_before")), "cve": F.array().cast("array<string>"), "cwe": F.when(F.col("vul_type").isNull() | (F.col("vul_type") == ""), F.array().cast("array<string>")).otherwise(F.array(F.upper("vul_type"))),
            "cve_desc": F.lit(None).cast("string"), "commit_message": F.lit(""), "deleted_lines": paired_changes(F.col("line_changes.deleted")), "added_lines": paired_changes(F.col("line_changes.added")), "source_row_idx": F.lit(None).cast("long"),
        }
    )
    return made.withColumn("pair_id", pair_id(F.lit(B), *map(F.col, ("project", "commit_id", "func_name", "vuln_hash")))).select(*PAIR_COLUMNS)


def self_linked(rows: DataFrame, link: str, key: str, within: list[str], ordinal: str, keep: list[str]) -> DataFrame:
    """Rows joined with the first row of the same `within` whose key is their link; its columns `keep` get the prefix to_."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*within, key).orderBy(ordinal))).filter("_n = 1")
    target = first.select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(within)), F.col(key).alias("_key"), *(F.col(c).alias(f"to_{c}") for c in keep))
    on = F.col(link) == F.col("_key")
    for i, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return rows.join(target, on).drop("_key", *(f"_w{i}" for i in range(len(within))))


def pairs_c(rows: DataFrame, file: str = "_file", ordinal: str = "idx") -> DataFrame:
    """Source C: a vulnerable function is linked to its fix by id within its file; line numbers that don't fit are repaired. Adds reindex_method and added_method."""
    vulnerable = "is_vulnerable and fixed_func_idx is not null and idx <> fixed_func_idx"
    linked = self_linked(rows.withColumn("_link", F.when(F.expr(vulnerable), F.col("fixed_func_idx").cast("long"))), "_link", "idx", [file], ordinal, ["func_body", "changed_lines"])
    described = strip(F.array_join(F.col("context.Explanation"), " "))
    made = with_repair(linked, "_del", encoded_changes(F.col("changed_lines")), F.col("func_body"), F.col("to_func_body"), True)
    made = with_repair(made, "_add", encoded_changes(F.col("to_changed_lines")), F.col("to_func_body"), F.col("func_body"), False)
    none = F.array().cast("array<string>")
    made = made.withColumns(
        {
            "source": F.lit(C), "vuln_func": F.col("func_body"), "patched_func": F.col("to_func_body"), "vuln_hash": code_hash(F.col("func_body")), "cve": F.coalesce("cve_list", none), "cwe": F.coalesce("cwe_list", none),
            "cve_desc": F.when(F.length(described) > 5, described), "commit_message": F.coalesce(present(F.col("commit_message")), F.lit("")), "deleted_lines": F.col("_del.changes"), "added_lines": F.col("_add.changes"),
            "source_row_idx": F.col("idx"), "reindex_method": F.col("_del.method"), "added_method": F.col("_add.method"),
        }
    )
    return made.withColumn("pair_id", pair_id(F.lit(C), *map(F.col, ("project", "commit_id", "func_name", "vuln_hash")))).select(*PAIR_COLUMNS, "reindex_method", "added_method")


def reindex_statistics(pairs: DataFrame) -> DataFrame:
    """How often each method of repair was needed, for deleted and added lines."""
    sides = F.array(F.struct(F.lit("deleted").alias("side"), F.col("reindex_method").alias("method")), F.struct(F.lit("added").alias("side"), F.col("added_method").alias("method")))
    return pairs.select(F.inline(sides)).groupBy("side", "method").agg(F.count("*").alias("n"))


def without_no_ops(pairs: DataFrame) -> DataFrame:
    """Pairs whose functions differ in more than trailing blanks."""
    return pairs.filter(~same_but_for_trailing_blanks(F.col("vuln_func"), F.col("patched_func")))


def labelled(pairs: DataFrame) -> DataFrame:
    """Two rows for each pair: the vulnerable and the patched function."""
    sides = F.array(F.struct(F.lit(True).alias("is_vulnerable"), F.col("vuln_func").alias("code")), F.struct(F.lit(False).alias("is_vulnerable"), F.col("patched_func").alias("code")))
    return pairs.select("*", F.inline(sides))

"""Metadata pooled over commits, heterogeneous commits, and fill-only enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NULL_AT_LOAD, NVD_PLACEHOLDERS, clean_list, has_description, sorted_set, strip
from ..schemas import A, B, C

#: Sources by whose description is preferred in a pool.
DESCRIPTIONS_FIRST = (A, C, B)


def rank_of(column: Column, names: tuple[str, ...]) -> Column:
    found = F.array_position(F.array(*map(F.lit, names)), column)
    return F.when(found > 0, found - 1).otherwise(99)


def union_of(items: Column) -> Column:
    return sorted_set(F.flatten(F.collect_set(items)))


def pool(pairs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row for each commit (in lower case): cve, cwe, cve_desc, commit_message, and is_heterogeneous.

    First by function, then by commit, so that a commit of many rows is reduced before it meets. A description is
    taken from the preferred source, the first in order among equals; the message is the longest, the first among
    equals. A commit is heterogeneous if its functions that have a value differ in CVEs, CWEs or description.
    """
    described = strip(F.col("cve_desc"))
    usable = F.col("cve_desc").isNotNull() & ~F.lower(described).isin(*NULL_AT_LOAD) & (F.length(described) > 5)
    rank = F.struct(rank_of(F.col("source"), DESCRIPTIONS_FIRST).alias("prio"), F.col(ordinal).alias("at"), described.alias("text"))
    message = F.when(F.coalesce(F.col("commit_message"), F.lit("")) != "", F.struct((-F.length("commit_message")).alias("size"), F.col(ordinal).alias("at"), F.col("commit_message").alias("text")))
    by_function = pairs.groupBy(F.lower("commit_id").alias("commit"), "func_name").agg(
        union_of(clean_list(F.col("cve"))).alias("cves"),
        union_of(F.filter(clean_list(F.col("cwe")), lambda x: ~x.isin(*NVD_PLACEHOLDERS))).alias("cwes"),
        F.min(F.when(usable, rank)).alias("desc"), F.min(message).alias("message"), F.min(ordinal).alias("at"),
    )
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    by_commit = by_function.groupBy("commit").agg(
        union_of(F.col("cves")).alias("cve"), union_of(F.col("cwes")).alias("cwe"),
        F.min(F.when(F.col("desc").isNotNull(), F.struct(F.col("desc.prio").alias("prio"), F.col("at").alias("at"), F.col("desc.text").alias("text")))).alias("desc"),
        F.min("message").alias("message"),
        ((F.count_distinct(some("cves")) > 1) | (F.count_distinct(some("cwes")) > 1) | (F.count_distinct("desc.text") > 1)).alias("is_heterogeneous"),
    )
    return by_commit.select("commit", "cve", "cwe", F.col("desc.text").alias("cve_desc"), F.coalesce("message.text", F.lit("")).alias("commit_message"), "is_heterogeneous")


def enrich(pairs: DataFrame, pooled: DataFrame) -> DataFrame:
    """Pairs with gaps filled from their commit's pool; what is there is never overwritten, only a shorter message is.

    Heterogeneous commits give their message alone. Lists are sorted and distinct.
    """
    p = pooled.select(F.col("commit").alias("_commit"), *(F.col(c).alias(f"_{c}") for c in ("cve", "cwe", "cve_desc", "commit_message", "is_heterogeneous")))
    joined = pairs.join(p, F.lower("commit_id") == F.col("_commit"), "left")
    may = F.coalesce(~F.col("_is_heterogeneous"), F.lit(False))
    own = lambda c: clean_list(F.col(c))
    filled = lambda c: sorted_set(F.when((F.size(own(c)) == 0) & may, F.col(f"_{c}")).otherwise(own(c)))
    longer = F.length(F.col("_commit_message")) > F.length(F.coalesce(F.col("commit_message"), F.lit("")))
    made = joined.withColumns(
        {
            "cve": filled("cve"), "cwe": filled("cwe"), "cve_desc": F.when(~has_description(F.col("cve_desc")) & may & F.col("_cve_desc").isNotNull(), F.col("_cve_desc")).otherwise(F.col("cve_desc")),
            "commit_message": F.when(longer, F.col("_commit_message")).otherwise(F.col("commit_message")),
        }
    )
    return made.select(*pairs.columns)

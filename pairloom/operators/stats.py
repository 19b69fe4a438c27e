"""Summaries of counts: totals, frequencies, caps, histograms, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import written
from .quantiles import with_percentiles

CAPS = (50, 75, 100)


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, min, max, mean, median, population and sample deviation, and exact percentiles."""
    v = F.col(value)
    facts = df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.stddev_samp(v).alias("std"))
    return with_percentiles(facts, df, value, {"median": 0.5, **{f"p{p}": p / 100 for p in (75, 90, 95, 99)}}, list(by or []))


def frequencies(df: DataFrame, value: str, name: str, above: int = 0, samples: int = 3) -> DataFrame:
    """(value, n, samples): how often each value is there; over `above`, the least names with it.

    The least names are merged partial by partial, so a value with very many rows isn't gathered in one task.
    """
    from .ordinals import first_by_category

    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    least = first_by_category(df.filter(F.col(value) > above).select(value, name).distinct(), [value], samples, name)
    named = least.groupBy(value).agg(F.array_sort(F.collect_list(name)).alias("samples"))
    return counts.join(named, value, "left")


def loss_if_capped(df: DataFrame, value: str, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """(cap, lost, percent): rows over each cap; caps are the fixed ones and the floors of three percentiles."""
    # few thresholds against counts by value, not against all rows
    by_value = written(df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k")), "counts")
    named = {f"p{i}": p for i, p in enumerate((0.75, 0.95, 0.99))}
    found = with_percentiles(by_value.agg(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))).alias("n")), by_value, "v", named, [], weight="k")
    thresholds = found.select("n", F.explode(F.array_distinct(F.array(*(F.floor(c).cast("long") for c in named), *(F.lit(c).cast("long") for c in caps)))).alias("cap")).filter("cap is not null")
    over = by_value.join(F.broadcast(thresholds), F.col("v") > F.col("cap"), "right")  # six thresholds
    return over.groupBy("cap", "n").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("lost")).select("cap", "lost", (100.0 * F.col("lost") / F.col("n")).alias("percent"))


def cap_threshold(df: DataFrame, count: str, percentile: float, multiplier: float = 1.0) -> DataFrame:
    """One row with the threshold: the percentile of counts that aren't zero, times the multiplier, rounded up; null without such counts."""
    found = with_percentiles(df.sparkSession.range(1), df.filter(F.col(count) > 0), count, {"p": percentile / 100}, [])
    return found.select(F.ceil(multiplier * F.col("p")).cast("long").alias("threshold"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n, density) of equal bins from the least to the largest value; the largest belongs to the last bin."""
    edge = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count(value).alias("total"))
    v = F.col(value).cast("double")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"), F.lit(bins - 1))).otherwise(0)
    binned = df.filter(v.isNotNull()).join(F.broadcast(edge)).groupBy(place.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))  # one row of edges
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    return binned.select("bin", "n", (F.col("n") / F.col("total") / width).alias("density"))


def coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """One row: total, and the count of rows in which each field's condition holds."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in fields.items()))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def with_total(df: DataFrame, by: str, **aggregates: Column) -> DataFrame:
    """Aggregates for each value of `by` and, with `by` null and is_total, for all rows."""
    return df.groupingSets([[by], []], by).agg(F.grouping(by).cast("boolean").alias("is_total"), *(c.alias(k) for k, c in aggregates.items()))

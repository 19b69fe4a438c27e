"""Analytics of completion logs: rates, gaps, batches, trends. Rows of one run are ordered by time, then by an id.

A run may hold a third of all rows, so no window spans one. Rows get their place in their run by ranges of the order,
and windows run over blocks of BLOCK places, into which the last rows of the block before are copied where a window
looks back. What a whole run decides (its size, first time, sums by block) is aggregated and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordinals import with_ordinal, written
from .quantiles import with_percentiles

# Seconds that part batches, characters a token, and the bounds of slow and anomalous batches.
GAP, CHARS_PER_TOKEN, SLOW, ANOMALOUS = 30, 4.5, 300, 5.0
#: Rows of a run that a window spans at most.
BLOCK = 1 << 18


def seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def joined(rows: DataFrame, facts: DataFrame, run: str, *columns: str) -> DataFrame:
    """rows with columns of facts, which has a row for each run."""
    r, f = rows.alias("r"), facts.alias("f")
    return r.join(f, F.col(f"r.{run}").eqNullSafe(F.col(f"f.{run}"))).select("r.*", *(f"f.{c}" for c in columns))


def placed(df: DataFrame, run: str, *order: str) -> DataFrame:
    """df with `_i`, each row's place in its run from 0, and `_n`, the run's rows."""
    numbered = with_ordinal(df, run, *order, name="_g")
    runs = numbered.groupBy(run).agg(F.min("_g").alias("_g0"), F.count("*").alias("_n"))
    return joined(numbered, runs, run, "_g0", "_n").withColumn("_i", F.col("_g") - F.col("_g0")).drop("_g", "_g0")


def blocks(rows: DataFrame, run: str, before: int, block: int | None = None) -> tuple[DataFrame, Window]:
    """(rows of placed() dealt to blocks, the last `before` of each also to the next one; the window over a block). own() takes the copies off."""
    size = block or BLOCK
    if before > size:
        raise ValueError("a window looks back no further than a block")
    at = F.floor(F.col("_i") / size)
    into = F.when(F.col("_i") % size >= size - before, F.array(at, at + 1)).otherwise(F.array(at))
    return rows.withColumn("_block", F.explode(into)).withColumn("_own", F.col("_block") == at), Window.partitionBy(run, "_block").orderBy("_i")


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("_own").drop("_own", "_block")


def completion_rate(df: DataFrame, run: str, ts: str, tie: str, size: int = 20, block: int | None = None) -> DataFrame:
    """Completions a minute over the last `size`, from the row that has so many before it; infinite where no time passed."""
    rows, w = blocks(placed(df.filter(F.col(ts).isNotNull()), run, ts, tie), run, size, block)
    rows = own(rows.withColumn("_before", F.lag(ts, size).over(w))).filter(F.col("_i") >= size)
    passed = seconds(F.col("_before"), F.col(ts))
    return rows.withColumn("rate", F.when(passed > 0, size / (passed / 60)).otherwise(F.lit(float("inf")))).drop("_before", "_i", "_n")


def inter_arrival(df: DataFrame, run: str, ts: str, tie: str, block: int | None = None) -> DataFrame:
    """Seconds since the row before (null for the first), minutes since the first, and rows so far."""
    rows, w = blocks(placed(df, run, ts, tie), run, 1, block)
    rows = own(rows.withColumn("delta_seconds", seconds(F.lag(ts, 1).over(w), F.col(ts))))
    first = rows.groupBy(run).agg(F.min_by(ts, "_i").alias("_first"))
    rows = joined(rows, first, run, "_first")
    return rows.withColumns({"elapsed_minutes": seconds(F.col("_first"), F.col(ts)) / 60, "completed": F.col("_i") + 1}).drop("_first", "_i", "_n")


def ordinal_buckets(df: DataFrame, run: str, ts: str, tie: str, values: tuple[str, ...]) -> DataFrame:
    """Tenths of a run by count (and a rest): size, minutes, rate, and means of values."""
    size = F.greatest(F.floor(F.col("_n") / 10), F.lit(1))
    rows = placed(df, run, ts, tie).withColumn("bucket", F.floor(F.col("_i") / size).cast("long"))
    passed = seconds(F.min(ts), F.max(ts)) / 60
    return rows.groupBy(run, "bucket").agg(F.count("*").alias("n"), passed.alias("minutes"), F.when(passed > 0, F.count("*") / passed).otherwise(F.lit(float("inf"))).alias("rate"), *(F.avg(v).alias(f"avg_{v}") for v in values))


def gap_sessions(df: DataFrame, run: str, ts: str, tie: str, gap: float = GAP, block: int | None = None) -> DataFrame:
    """Rows with the number of their batch: a new one begins after a longer gap than `gap` seconds."""
    rows, w = blocks(placed(df, run, ts, tie), run, 1, block)
    new = F.coalesce((seconds(F.lag(ts, 1).over(w), F.col(ts)) > gap).cast("int"), F.lit(0))
    rows = rows.withColumn("_new", new).filter("_own")
    within = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(run, "_block").agg(F.sum("_new").alias("_s"))  # one row for each block
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(run).orderBy("_block")) - F.col("_s"))
    r, s = rows.withColumn("_within", within).alias("r"), sums.alias("s")
    both = r.join(s, F.col(f"r.{run}").eqNullSafe(F.col(f"s.{run}")) & (F.col("r._block") == F.col("s._block"))).select("r.*", "s._before")
    return both.withColumn("batch", F.col("_before") + F.col("_within")).drop("_before", "_within", "_new", "_own", "_block", "_i", "_n")


def batch_facts(df: DataFrame, run: str, ts: str, tie: str, length: str, value: str) -> DataFrame:
    """One row for each batch: size, duration (from the end of the one before), longest, tokens a second, mean value, and whether it is slow or anomalous."""
    batches = gap_sessions(df, run, ts, tie).groupBy(run, "batch").agg(F.count("*").alias("size"), F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max(length).alias("max_length"), F.avg(value).alias("avg_value"))
    # batches are numbered without holes, so the one before is found by its number
    b, last = batches.alias("b"), batches.select(F.col(run).alias("_run"), (F.col("batch") + 1).alias("_next"), F.col("_last").alias("_before")).alias("l")
    both = b.join(last, F.col(f"b.{run}").eqNullSafe(F.col("_run")) & (F.col("b.batch") == F.col("_next")), "left").select("b.*", "_before")
    facts = both.withColumn("duration", seconds(F.coalesce("_before", "_first"), F.col("_last")))
    facts = facts.withColumn("tokens_per_second", F.when(F.col("duration") > 0, F.col("max_length") / CHARS_PER_TOKEN / F.col("duration")).otherwise(F.lit(float("inf"))))
    return facts.withColumns({"is_slow": F.col("duration") > SLOW, "is_anomalous": F.col("tokens_per_second") < ANOMALOUS}).drop("_first", "_last", "_before")


def batch_summary(facts: DataFrame, run: str) -> DataFrame:
    """One row for each run: batches, durations, and the shares of slow and anomalous ones."""
    d = F.col("duration")
    part = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), d)), F.lit(0.0))
    share = lambda flag: F.when(F.sum(d) > 0, 100 * part(flag) / F.sum(d)).otherwise(0.0)
    facts = written(facts, "batches")
    sums = facts.groupBy(run).agg(F.count("*").alias("batches"), F.avg(d).alias("mean_duration"), F.max(d).alias("max_duration"), *(F.count_if(F.col(f"is_{k}")).alias(k) for k in ("slow", "anomalous")), *(share(f"is_{k}").alias(f"{k}_percent") for k in ("slow", "anomalous")))
    return with_percentiles(sums, facts, "duration", {"median_duration": 0.5}, [run])


def rolling_median(df: DataFrame, run: str, ts: str, tie: str, value: str, before: int = 20, part: int | None = None, block: int | None = None) -> DataFrame:
    """Median of the value over a row and the `before` ones before it; with `part`, over at most a part-th of the run's rows before."""
    rows, w = blocks(placed(df, run, ts, tie), run, before, block)
    if part is None:
        return own(rows.withColumn("rolling_median", F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-before, 0)))).drop("_i", "_n")
    wide = F.least(F.lit(before), F.floor(F.col("_n") / part)).cast("int") + 1
    last = F.reverse(F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-before, 0)))
    seen = F.array_sort(F.filter(F.transform(F.slice(last, F.lit(1), wide), lambda x: x["v"]), lambda x: x.isNotNull()))
    n = F.size("_seen")
    middle = (F.get("_seen", F.floor((n - 1) / 2).cast("int")) + F.get("_seen", F.floor(n / 2).cast("int"))) / 2
    return own(rows.withColumn("_seen", seen)).withColumn("rolling_median", middle).drop("_seen", "_i", "_n")


def moving_average(df: DataFrame, run: str, ts: str, tie: str, value: str, size: int = 20, block: int | None = None) -> DataFrame:
    """Mean of the last `size` values, from the row that completes so many."""
    rows, w = blocks(placed(df, run, ts, tie), run, size - 1, block)
    return own(rows.withColumn("moving_average", F.avg(value).over(w.rowsBetween(-(size - 1), 0)))).filter(F.col("_i") >= size - 1).drop("_i", "_n")


def slowdown_onset(rates: DataFrame, run: str, ts: str, tie: str, factor: float = 0.3) -> DataFrame:
    """(run, onset): place among the rates (from 0) of the first under `factor` of the mean of the first tenth; null if there is none."""
    rows = placed(rates, run, ts, tie)
    head = F.col("_i") < F.greatest(F.floor(F.col("_n") / 10), F.lit(1))
    base = rows.filter(head).groupBy(run).agg(F.avg("rate").alias("_base"))
    return joined(rows, base, run, "_base").groupBy(run).agg(F.min(F.when(F.col("rate") < factor * F.col("_base"), F.col("_i"))).cast("long").alias("onset"))


def long_rows(df: DataFrame, run: str, length: str) -> DataFrame:
    return df.groupBy(run).agg(F.count_if(F.col(length) > 30_000).alias("over_30k"), F.count_if(F.col(length) > 50_000).alias("over_50k"))


def trajectory(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Values of a series (nulls left out) at its beginning, quarters and end, where it has six or more: (series, place, value)."""
    rows = df.filter(F.col(value).isNotNull())
    n, i = F.col("_n"), F.col("_i")
    numbered = placed(rows, series, *order)
    at = F.array(F.lit(0), F.lit(1), F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4), n - 2, n - 1).cast("array<long>")
    return numbered.filter((n >= 6) & F.array_contains(at, i.cast("long"))).select(series, i.cast("long").alias("place"), F.col(value).alias("value"))


def first_to_last(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """One row for each series: points, range, mean, sample deviation, first and last value; nulls are left out."""
    rows = df.filter(F.col(value).isNotNull())
    at = F.struct(*order)
    v = F.col(value)
    return rows.groupBy(series).agg(F.count(v).alias("points"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last"))


def quartile_trend(df: DataFrame, series: str, order: list[str], value: str, least: int = 20, flat: float = 0.02) -> DataFrame:
    """Change from the mean of the first n // 4 values to that of the last ceil(n / 4), of series with enough points."""
    rows = df.filter(F.col(value).isNotNull())
    numbered = placed(rows, series, *order).filter(F.col("_n") >= least)
    head, tail = F.col("_i") < F.floor(F.col("_n") / 4), F.col("_i") >= F.col("_n") - F.ceil(F.col("_n") / 4)
    ends = numbered.groupBy(series).agg(F.avg(F.when(head, F.col(value))).alias("first_quarter"), F.avg(F.when(tail, F.col(value))).alias("last_quarter"))
    delta = F.col("last_quarter") - F.col("first_quarter")
    return ends.withColumn("delta", delta).withColumn("trend", F.when(F.abs(delta) < flat, "flat").when(delta > 0, "up").otherwise("down"))


# The series that diagnostics look at.
CLIP, SCORE, ENTROPY, RESPONSE_LENGTH, VALIDATION = "actor/pg_clipfrac", "critic/score/mean", "actor/entropy", "response_length/mean", "val-core/vulnerability_detection/acc/mean@1"


def diagnostics(history: DataFrame, step: str = "training/global_step") -> DataFrame:
    """(series, finding, value) of a wide training history, by fixed thresholds; a series that is missing or too short has no row."""
    there = [c for c in (CLIP, SCORE, ENTROPY, RESPONSE_LENGTH, VALIDATION) if c in history.columns]
    if not there:
        raise ValueError("no known series")
    pairs = F.array(*(F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").cast("double").alias("v")) for c in there))
    tall = history.select(F.col(f"`{step}`").alias("step"), F.inline(pairs)).filter("v is not null and not isnan(v)")
    ends = first_to_last(tall, "series", ["step"], "v")
    s, first, last, mean, n = (F.col(c) for c in ("series", "first", "last", "mean", "points"))
    value = F.when(s == CLIP, mean).when(s == ENTROPY, last / first).otherwise(last - first)
    finding = (
        F.when((s == CLIP) & (mean < 0.01), "clip fraction very low").when((s == CLIP) & (mean > 0.20), "clip fraction high")
        .when((s == ENTROPY) & (n >= 10) & (last < first * 0.5), "entropy collapsed").when((s == ENTROPY) & (n >= 10) & (last < first * 0.8), "entropy decreased")
        .when((s == RESPONSE_LENGTH) & (n >= 10) & (last - first < -500), "responses shorter").when((s == RESPONSE_LENGTH) & (n >= 10) & (last - first > 500), "responses longer")
        .when((s == VALIDATION) & (n >= 2), "validation accuracy changed")
    )
    found = ends.select(s, finding.alias("finding"), value.alias("value")).filter("finding is not null")
    trend = quartile_trend(tall.filter(s == SCORE), "series", ["step"], "v")
    return found.unionByName(trend.select(s, F.concat(F.lit("reward "), "trend").alias("finding"), F.col("delta").alias("value")))

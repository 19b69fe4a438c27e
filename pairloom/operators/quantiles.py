"""Exact percentiles without a task that holds a group's values.

Values are counted first, so repetitions cost nothing later. A percentile lies
between two ranks; for each rank a range of values is kept that holds it. As long
as a range holds many values, it is cut at PIVOTS of them (approximate quantiles
of its values, which merge), counts by piece tell in which the rank lies, and the
range shrinks to that piece. So each round leaves about one in PIVOTS values, for
whatever distribution, and what is left at the end is small enough to be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordinals import written

#: Pieces of a range in a round; distinct values of a range that one task orders; rows of ranges that are broadcast, at most.
PIVOTS, ORDERED, MOST_BROADCAST = 64, 10_000, 500_000


def _in_ranges(counts: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Each range's values, with their counts."""
    few = ranges.count() <= MOST_BROADCAST
    c, r = counts.alias("c"), (F.broadcast(ranges) if few else ranges.hint("merge")).alias("r")
    on = (F.col("r.low").isNull() | (F.col("v") > F.col("r.low"))) & (F.col("r.high").isNull() | (F.col("v") <= F.col("r.high")))
    for name in by:
        on = F.col(f"c.{name}").eqNullSafe(F.col(f"r.{name}")) & on
    return c.join(r, on).select("r.*", "v", "k")


def ranks(counts: DataFrame, wanted: DataFrame, by: list[str], ordered: int = ORDERED) -> DataFrame:
    """(by..., rank, value): the value at each wanted rank (from 0) of counts (by..., v, k)."""
    kind = counts.schema["v"].dataType
    ranges = written(wanted.select(*by, "rank", "held", F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high"), F.lit(0).cast("long").alias("below")), "ranges")
    steps = [k / PIVOTS for k in range(1, PIVOTS)]
    keys = [*by, "rank"]
    while ranges.filter(F.col("held") > ordered).limit(1).count():
        wide = ranges.filter(F.col("held") > ordered)
        pivots = _in_ranges(counts, wide, by).groupBy(*keys, "low", "high", "below").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", steps, 16 * PIVOTS))).alias("pivots"))
        cut = _in_ranges(counts, written(pivots, "pivots"), by)
        piece = F.size(F.filter("pivots", lambda x: x < F.col("v")))
        # a piece is what lies over one pivot and not over the next
        sums = cut.groupBy(*keys, "low", "high", "below", "pivots", piece.alias("piece")).agg(F.sum("k").alias("k"), F.count("*").alias("n"))
        upto = F.sum("k").over(Window.partitionBy(*keys).orderBy("piece"))  # PIVOTS rows at most
        found = sums.withColumn("upto", F.col("below") + upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
        low = F.when(F.col("piece") == 0, F.col("low")).otherwise(F.get("pivots", F.col("piece") - 1))
        high = F.when(F.col("piece") == F.size("pivots"), F.col("high")).otherwise(F.get("pivots", F.col("piece")))
        narrowed = found.select(*keys, F.col("n").alias("held"), low.alias("low"), high.alias("high"), (F.col("upto") - F.col("k")).alias("below"))
        ranges = written(ranges.filter(F.col("held") <= ordered).unionByName(narrowed), "ranges")
    upto = F.col("below") + F.sum("k").over(Window.partitionBy(*keys).orderBy("v"))
    last = _in_ranges(counts, ranges, by).withColumn("upto", upto)
    return last.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k"))).select(*keys, F.col("v").alias("value"))


def percentiles(df: DataFrame, value: str | Column, at: list[float], by: list[str] | None = None, ordered: int = ORDERED, weight: str | None = None) -> DataFrame:
    """(by..., percentiles): an array of the exact percentiles at shares of 0 to 1, between two values in proportion; nulls are left out.

    weight: a column that tells how often a row counts. A group without values has no row. NaN is over all other values.
    """
    by, v = list(by or []), F.col(value) if isinstance(value, str) else value
    counts = written(df.select(*by, v.alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("k")).filter("v is not null").groupBy(*by, "v").agg(F.sum("k").alias("k")), "counts")
    sizes = counts.groupBy(*by).agg(F.sum("k").alias("n"), F.count("*").alias("held")).filter("n > 0")
    places = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("h")) for i, p in enumerate(at)))
    places = written(sizes.select(*by, "held", F.inline(places)).withColumns({"lower": F.floor("h").cast("long"), "upper": F.ceil("h").cast("long")}), "places")
    wanted = places.select(*by, "held", F.explode(F.array("lower", "upper")).alias("rank")).distinct()
    found = written(ranks(counts, wanted, by, ordered), "ranks")
    value_at = F.map_from_entries(F.collect_list(F.struct("rank", F.col("value").cast("double").alias("value"))))  # two for each share
    told = found.groupBy(*by).agg(value_at.alias("m"))
    both = places.alias("p").join(told.alias("t"), _same(by)).select(*(f"p.{c}" for c in by), "i", "h", F.col("m")[F.col("lower")].alias("a"), F.col("m")[F.col("upper")].alias("b"), "lower")
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.col("lower"))
    one = both.select(*by, F.struct("i", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("x")).alias("s"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("percentiles"))


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for name in by:
        on = on & F.col(f"p.{name}").eqNullSafe(F.col(f"t.{name}"))
    return on


def with_percentiles(facts: DataFrame, df: DataFrame, value: str, named: dict[str, float], by: list[str], weight: str | None = None) -> DataFrame:
    """facts, a row for each group, with a column for each percentile; null where a group has no values."""
    found = percentiles(df, value, list(named.values()), by, weight=weight)
    both = facts.alias("p").join(found.alias("t"), _same(by), "left")
    return both.select("p.*", *(F.get("t.percentiles", F.lit(i)).alias(name) for i, name in enumerate(named)))

"""Connected components of a distributed edge list, with nothing collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .common import written as table_of


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the minimum m of u. Both sides are read from written tables, so that a join on a hot u can be split."""
    return edges.join(least, "u")


#: Edges that one task takes, about: few edges don't become many small files.
TASK = 50_000


def components(edges: DataFrame, rounds: int = 60, task: int = TASK) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al.): each links a
    node's neighbours to its least one, which shortens paths until stars remain.
    A step groups by node with partial aggregation, and its output is a written
    table, in as many parts as the number of edges asks for. The steps needed grow
    with the logarithm of the edges; more than `rounds` are an error. Self-loops
    and repeated edges change nothing; no edges give no rows.
    """
    stars = table_of(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, most = None, partitions(edges)
    parts = 1 + stars.count() // task  # edges don't become more

    def written(df, name):
        return table_of(df.coalesce(parts) if parts < most else df, name)

    for _ in range(rounds):
        both = written(stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = _joined(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _joined(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if before == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")

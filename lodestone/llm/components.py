"""Connected components of a link table, by alternating large-star and small-star steps.

Each step keeps the number of links and takes two shuffles; about log(diameter) rounds are enough. Minima are
joined back rather than gathered, so a hub's links need not fit a task; every round is written to the shared
folder. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. Large: each node ties its larger neighbours to the least of its neighbourhood.
    Small: each node ties its smaller neighbours, and itself, to the least of these."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: two columns a, b of comparable ids, in any order. Returns (node, component) for every node that has
    a link to another; component is its component's least node. Null ends and self-links are left out."""
    a, b = links.columns[:2]
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, seen = materialise(now, "links"), None
    for _ in range(most_rounds):
        now = materialise(_star(_star(now, True), False), "links")
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == seen or not n:
            break
        seen = (n, total)
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

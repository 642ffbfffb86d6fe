"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not its component's least node.

    Each round links every node to the least node of its neighbourhood: first its greater
    neighbours, then itself and its smaller ones. Rounds end when the links are all stars;
    their number grows with the logarithm of a component's size. Links stay in tables: only
    a count and a checksum of each round come to the driver. No edges give an empty table;
    loops and repeated links do nothing. Ids must not be null.
    """
    now = settle(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, both["u"] == least["k"]).filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = settle(large.distinct(), "links")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(low, large["u"] == low["k"])
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select(F.col("k").alias("u"), F.col("m").alias("v"))
        )
        now = settle(small.distinct(), "links")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(sums)

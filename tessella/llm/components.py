"""Connected components of a graph of string-named nodes by alternating large-star and small-star (Kiveris et al. 2014).

Each round takes a minimum per node, which combines before it shuffles, and joins it with the links;
nodes with a large part of all links are joined by broadcasting.  Links are written to the checkpoint
folder after each round, and only two sums of a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import cut, join_groups


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _nearest(links: DataFrame, node: str, other: str, total: int) -> DataFrame:
    """links with low: the least other end of any link at the same node."""
    lows = links.groupBy(node).agg(F.min(other).alias("low"), F.count("*").alias("degree"))
    return join_groups(links, lows, node, "degree", total)


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): (node, root), one row per node that has a link to another; root is the least node of its component.  Self-links and nulls are ignored."""
    links = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = cut(links.distinct())
    before = _state(links)
    while before[0]:
        # large star: what is above a node goes to the least of its neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree")).withColumn("low", F.least("low", "a")).withColumnRenamed("a", "b")
        large = join_groups(links, lows, "b", "degree", before[0]).select("a", F.col("low").alias("b")).distinct()
        large = cut(large)
        # small star: a node and what is below it go to the least below it
        small = _nearest(large, "a", "b", before[0])
        small = small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("link")).select("link.*")
        links = cut(small.where("a != b").distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

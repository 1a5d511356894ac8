"""Connected components of a graph given as a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.session import materialise, remove


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``, longs): root is the smallest node reachable.

    Each round hangs the larger neighbours of every node on the smallest of its neighbourhood (large
    star), then the smaller ones (small star), until all links are stars. The smallest neighbour is
    summed by node before it moves, and its join back can be split where a node has very many links.
    Each round's links are written to the shared folder, so a lost executor costs one round at most.
    Links with a null end are dropped; repeated links and loops change nothing.
    """
    both = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialise(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    while state[0]:
        # Large star: every node's neighbours above it go to the least of its neighbourhood.
        sides = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        large = sides.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n"))
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # Small star: every node and its smaller neighbours go to the least of these.
        under = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(under, F.col("a") == F.col("n"))
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        then = materialise(small.distinct(), label)
        new = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        remove(now)
        now = then
        if new == state:
            break
        state = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

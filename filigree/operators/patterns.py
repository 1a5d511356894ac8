"""Patterns up to isomorphism: Weisfeiler-Lehman hashes and counts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.graph import drop_loops, induced
from filigree.operators.sampling import order_of
from filigree.session import materialise


def wl_hash(members: DataFrame, edges: DataFrame, rounds: int, anchored: bool = True) -> DataFrame:
    """``nb, size, wl_hash``: the same for induced subgraphs that colour refinement can't tell apart.

    A round gives every member a hash of its label and its neighbours' sorted labels; the graph's hash is that of its sorted labels
    after ``rounds``, of which the size of the largest pattern is enough. ``anchored`` marks the anchor in the beginning.
    """
    inner = materialise(drop_loops(induced(edges, members)), "wl-edges")
    start = F.when(F.col("node") == F.col("anchor"), "a").otherwise("n") if anchored else F.lit("n")
    labels = members.select("nb", "node", F.md5(start).alias("label"))
    for k in range(rounds):
        of = labels.select(F.col("nb").alias("l_nb"), F.col("node").alias("l_node"), F.col("label").alias("l"))
        near = inner.join(of, (F.col("nb") == F.col("l_nb")) & (F.col("dst") == F.col("l_node"))).groupBy("nb", F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("l")), "").alias("ls"))
        labels = labels.join(near, ["nb", "node"], "left").select("nb", "node", F.md5(F.concat("label", F.coalesce("ls", F.lit("")))).alias("label"))
        if k % 3 == 2:
            labels = materialise(labels, "wl-labels")
    return labels.groupBy("nb").agg(F.count("*").alias("size"), F.md5(F.array_join(F.sort_array(F.collect_list("label")), "")).alias("wl_hash"))


def pattern_counts(patterns: DataFrame) -> DataFrame:
    """``size, wl_hash, n`` of patterns (``size, wl_hash, anchor``)."""
    return patterns.groupBy("size", "wl_hash").agg(F.count("*").alias("n"))


def pattern_totals(patterns: DataFrame) -> DataFrame:
    """One row: how many patterns there are, and how many different ones."""
    return patterns.agg(F.count("*").alias("n_total"), F.countDistinct("size", "wl_hash").alias("n_unique"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two stores as one."""
    return left.unionByName(right)


def top_patterns(patterns: DataFrame, max_per_size: int = 10, seed: int = 42) -> DataFrame:
    """``size, wl_hash, n, anchor``: of each size the most frequent hashes, and of each the example with the lowest hash of its anchor."""
    by = patterns.groupBy("size", "wl_hash").agg(F.count("*").alias("n"), F.min(F.struct(order_of(seed, "example", "anchor").alias("h"), F.col("anchor"))).alias("e"))
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("n"), "wl_hash"))
    return by.withColumn("_r", rank).filter(F.col("_r") <= max_per_size).select("size", "wl_hash", "n", F.col("e.anchor").alias("anchor"))

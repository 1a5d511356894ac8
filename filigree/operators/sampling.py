"""Samples that come out the same again: every choice is the rank of a hash of seed, step and key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators import graph
from filigree.operators.ranks import numbered, running, with_totals
from filigree.registry import SAMPLERS
from filigree.session import materialise


def order_of(seed: int, stage: str, *keys: str) -> Column:
    """A hash by which to sort: hexadecimal MD5, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), *[F.col(k).cast("string") for k in keys]))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42, stage: str = "sample") -> DataFrame:
    """``n`` rows, those with the lowest hash of ``key``."""
    return df.withColumn("_h", order_of(seed, stage, key)).orderBy("_h", key).limit(n).drop("_h")


def down_sample(candidates: DataFrame, group: list[str], key: str, ratio: float | None = None, most: int | None = None, seed: int = 42, named: list[str] | None = None) -> DataFrame:
    """Of each group ``max(1, round(ratio * n))`` rows (half to even) and at most ``most``, by hash (of ``named`` instead of the group's columns)."""
    if ratio is None and most is None:
        return candidates
    w = Window.partitionBy(*group)
    d = candidates if ratio is None else candidates.withColumn("_n", F.count("*").over(w))
    d = d.withColumn("_r", F.row_number().over(w.orderBy(order_of(seed, "cands", *(named or group), key), key)))
    if ratio is not None:
        d = d.filter(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.lit(ratio) * F.col("_n"), 0).cast("int")))
    if most is not None:
        d = d.filter(F.col("_r") <= most)
    return d.drop("_n", "_r")


def choose_graphs(graphs: DataFrame, n: int, seed: int = 42, parts: int = 4096) -> DataFrame:
    """``draw, graph_id``: ``n`` draws of a graph with a probability that follows ``num_nodes``: a range lookup in the running sum."""
    upto = running(graphs, ["graph_id"], F.col("num_nodes"), "before", "graphs").withColumn("upto", F.col("before") + F.col("num_nodes")).drop("before")
    upto = with_totals(upto, all=F.sum("num_nodes"))
    draws = graphs.sparkSession.range(n).select(F.col("id").alias("draw"))
    u = F.conv(F.substring(order_of(seed, "graph", "draw"), 1, 12), 16, 10).cast("double") / float(16**12)
    # Graphs and draws meet by stretches of the running sum, so neither is held whole anywhere.
    part = lambda x: F.floor(x / F.col("all") * parts)
    low = F.col("upto") - F.col("num_nodes")
    spread = upto.filter("num_nodes > 0").select("graph_id", low.alias("low"), "upto", "all", F.explode(F.sequence(part(low), part(F.col("upto")))).alias("part"))
    drawn = draws.select("draw", u.alias("u"), F.floor(u * parts).alias("part")).join(spread, "part")
    return drawn.filter((F.col("u") * F.col("all") < F.col("upto")) & (F.col("u") * F.col("all") >= F.col("low"))).select("draw", "graph_id")


def grow(starts: DataFrame, edges: DataFrame, size: str, most: int, seed: int = 42, multiset: bool = False) -> DataFrame:
    """``nb, anchor, node, step``: random connected growth from ``anchor`` to ``size`` nodes, step by step for all sets at once.

    A step adds one node of the frontier: each equally likely, or, as a ``multiset``, as likely as it has links into the set.
    A set that has no frontier any more stays smaller. ``starts``: ``nb, anchor`` and the column ``size``.
    """
    todo = materialise(starts.select("nb", "anchor", F.col(size).alias("size")), "grow")
    members = todo.select("nb", "anchor", F.col("anchor").alias("node"), F.lit(0).alias("step"), "size")
    for k in range(1, most):
        open_ = members.filter(F.col("size") > k)
        links = open_.join(edges, F.col("node") == F.col("src")).select("nb", "anchor", "size", F.col("src"), F.col("dst").alias("to"))
        taken = members.select(F.col("nb").alias("t_nb"), F.col("node").alias("t_node"))
        links = links.join(taken, (F.col("nb") == F.col("t_nb")) & (F.col("to") == F.col("t_node")), "left_anti")
        h = order_of(seed, f"grow{k}", "nb", "to", *(["src"] if multiset else []))
        pick = links.groupBy("nb", "anchor", "size").agg(F.min(F.struct(h.alias("h"), F.col("to"))).alias("p"))
        # Each step is written alone, and the sets so far are the tables of all steps.
        members = members.unionByName(materialise(pick.select("nb", "anchor", F.col("p.to").alias("node"), F.lit(k).alias("step"), "size"), "grow"))
    return members


def _starts(nodes: DataFrame, n: int, low: int, high: int, seed: int) -> DataFrame:
    """``nb, anchor, size``: ``n`` anchors, in turns over all nodes in order of their hash, and sizes spread over [low, high]."""
    count = max(1, nodes.count())
    ranked = numbered(nodes.select("node").withColumn("h", order_of(seed, "start", "node")), ["h", "node"], "k", "starts")
    turns = nodes.sparkSession.range(n).select(F.col("id").alias("nb"), (F.col("id") % count).alias("j"))
    out = turns.join(ranked, F.col("j") == F.col("k")).select("nb", F.col("node").alias("anchor"))
    return out.withColumn("size", (F.pmod(F.conv(F.substring(order_of(seed, "size", "nb"), 1, 8), 16, 10).cast("long"), F.lit(high - low + 1)) + low).cast("int"))


@SAMPLERS.register("tree")
def tree(nodes: DataFrame, edges: DataFrame, n_neighborhoods: int = 10_000, min_size: int = 1, max_size: int = 30, seed: int = 42, multiset: bool = False, exact: bool = True) -> DataFrame:
    """``nb, anchor, node, step``: anchored connected sets of a size drawn from [min_size, max_size].

    ``exact`` leaves out sets whose component was too small for their size, as rejection would for ever try again.
    """
    made = materialise(grow(_starts(nodes, n_neighborhoods, min_size, max_size, seed), edges, "size", max_size, seed, multiset), "tree")
    if not exact:
        return made.drop("size")
    full = made.groupBy(F.col("nb").alias("f_nb"), F.col("size").alias("f_size")).agg(F.count("*").alias("n")).filter(F.col("n") == F.col("f_size"))
    return made.join(full, F.col("nb") == F.col("f_nb"), "left_semi").drop("size")


@SAMPLERS.register("tree_fast")
def tree_fast(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """`tree` with nodes as likely as they have links into the set."""
    return tree(nodes, edges, multiset=True, **options)


@SAMPLERS.register("radial")
def radial(nodes: DataFrame, edges: DataFrame, radius: int = 2, subsample_size: int = 0, seed: int = 42) -> DataFrame:
    """``nb, anchor, node``: all within ``radius`` of each node, or ``subsample_size`` of them by hash, as far as the anchor reaches them.

    Sets of one node are left out, after the cut to the anchor's component too.
    """
    m = graph.khop(edges, nodes, radius).select("nb", F.col("nb").alias("anchor"), "node")
    if subsample_size:
        others = m.filter(F.col("node") != F.col("anchor"))
        rank = F.row_number().over(Window.partitionBy("nb").orderBy(order_of(seed, "radial", "nb", "node"), "node"))
        some = others.withColumn("_r", rank).filter(F.col("_r") <= subsample_size).drop("_r")
        m = materialise(some.unionByName(m.filter(F.col("node") == F.col("anchor"))), "radial")
        m = graph.component_of_anchor(m, edges, subsample_size)
    return m.withColumn("_n", F.count("*").over(Window.partitionBy("nb"))).filter(F.col("_n") > 1).drop("_n")


SAMPLERS.register("radial_fast")(radial)


def batches(nodes: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``node, batch``: nodes in hash order cut into batches; for reports, as all starts are searched at once."""
    ranked = numbered(nodes.select("node").withColumn("h", order_of(seed, "batch", "node")), ["h", "node"], "k", "batches")
    return ranked.select("node", F.floor(F.col("k") / size).cast("long").alias("batch"))


def uniform(seed: int, *keys: object) -> float:
    """A number in [0, 1) of a key, for code that runs outside of Spark's expressions."""
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:12], 16) / 16**12


def seeded_rows(n: int, spark, made, schema: str) -> DataFrame:
    """``made(i)`` yields rows for each i under ``n``, in parallel; the same rows for the same i."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for i in part["id"].tolist() for row in made(i)]
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")]) if rows else pd.DataFrame({c.strip().split()[0]: [] for c in schema.split(",")})

    return spark.range(n).mapInPandas(run, schema)

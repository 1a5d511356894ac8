"""Where graphs come from: tables, relations, collections of small graphs, and the tables of an order system.

A source gives ``(nodes, edges)``: ``nodes(node, y)``, ``edges(src, dst)`` in both directions without loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import graph, sampling
from filigree.operators.ranks import running
from filigree.registry import SOURCES
from filigree.sources import mat as matlab

Graph = tuple[DataFrame, DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked(nodes: DataFrame, edges: DataFrame) -> Graph:
    return nodes.select("node", F.col("y") if "y" in nodes.columns else F.lit(0).alias("y")), graph.undirected(graph.drop_loops(edges))


@SOURCES.register("parquet")
def parquet(spark: SparkSession, path: str) -> Graph:
    """``path/nodes.parquet`` and ``path/edges.parquet``."""
    return marked(table(spark, path, "nodes"), table(spark, path, "edges"))


@SOURCES.register("relation")
def relation(spark: SparkSession, path: str, relation: str) -> Graph:
    """One relation of ``edges(rel, src, dst)``; ``nodes(node, label)`` 0 or 1 become 0 or 2."""
    return one_relation(table(spark, path, "nodes"), table(spark, path, "edges"), relation)


@SOURCES.register("mat")
def mat(spark: SparkSession, path: str, relation: str) -> Graph:
    """One relation of a MATLAB file of sparse matrices, with the classes of its nodes in ``label``."""
    return one_relation(*matlab.relations(spark, path), relation)


def one_relation(nodes: DataFrame, e: DataFrame, relation: str) -> Graph:
    rel = e.filter(F.col("rel").isin(relation, f"net_{relation}"))
    if rel.isEmpty():
        raise ValueError(f"no relation {relation!r}; there are {sorted(r['rel'] for r in e.select('rel').distinct().collect())}")
    return marked(nodes.select("node", (F.col("label") * 2).alias("y")), rel)


@SOURCES.register("merged")
def merged(spark: SparkSession, path: str) -> Graph:
    """All relations as one graph; class 1 becomes 2, all others 0, and ``labeled`` says which nodes had a class at all."""
    nodes = table(spark, path, "nodes")
    return marked(binary_labels(nodes), table(spark, path, "edges"))


def binary_labels(nodes: DataFrame, label: str = "y", unknown: int = 2) -> DataFrame:
    """``node, y, labeled``: 1 becomes 2, others 0; ``unknown`` has no label."""
    return nodes.select("node", F.when(F.col(label) == 1, 2).otherwise(0).alias("y"), (F.col(label) != unknown).alias("labeled"))


@SOURCES.register("collection")
def collection(spark: SparkSession, path: str, anomaly_class: int = 0, n_anomaly_graphs: int = 20, seed: int = 42) -> Graph:
    """Many small graphs as one: all normal ones and some of the anomalous class, by hash. ``graphs(graph_id, num_nodes, y)``, ``edges(graph_id, src, dst)``."""
    kept = choose_class(table(spark, path, "graphs"), anomaly_class, n_anomaly_graphs, seed)
    return union_graph(kept, table(spark, path, "edges"))


def choose_class(graphs: DataFrame, anomaly_class: int, n: int, seed: int = 42) -> DataFrame:
    """All graphs of other classes (``y`` 0) and ``n`` of the anomalous one (``y`` 2)."""
    odd = sampling.hash_sample(graphs.filter(F.col("y") == anomaly_class), "graph_id", n, seed, "graphs")
    return graphs.filter(F.col("y") != anomaly_class).withColumn("y", F.lit(0)).unionByName(odd.withColumn("y", F.lit(2)))


def union_graph(graphs: DataFrame, edges: DataFrame) -> Graph:
    """A disjoint union; nodes carry their graph's ``y``."""
    moved = running(graphs, ["graph_id"], F.col("num_nodes"), "offset", "offsets")
    nodes = moved.select(F.col("y"), F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("num_nodes") - 1)).alias("node"))
    return marked(nodes, graph.offset_union(graphs, edges))


@SOURCES.register("copurchase")
def copurchase(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    """Parts that stand in ``least`` or more common orders. The pairs within an order are bounded by its lines."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    other = items.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("dst"))
    pairs = items.join(other, (F.col("l_orderkey") == F.col("k")) & (F.col("l_partkey") < F.col("dst")))
    pairs = pairs.groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # Pairs are there once, so both directions are too.
    both = pairs.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    edges = both.select("e.src", "e.dst")
    return graph.nodes_of(edges).withColumn("y", F.lit(0)), edges


@SOURCES.register("supply")
def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and the parts they sold; parts have negative ids less one, so that the two don't meet."""
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"))
    edges = graph.undirected(sold)
    return graph.nodes_of(edges).withColumn("y", F.lit(0)), edges


def load(spark: SparkSession, name: str, path: str, **options) -> Graph:
    """A source by name; an unknown name is an error that lists the names."""
    return SOURCES.build(name, spark, path, **options)


def anomaly_label(task: str, y: str = "y") -> Column:
    """Which labels count: bit 1 for ``structural-anomaly``, bit 0 for ``context-anomaly``, any for ``anomaly``."""
    made = {
        "structural-anomaly": F.shiftright(F.col(y), 1).bitwiseAND(1),
        "context-anomaly": F.col(y).bitwiseAND(1),
        "anomaly": (F.col(y) > 0).cast("int"),
    }
    if task not in made:
        raise ValueError(f"unknown task {task!r}; there are {', '.join(made)}")
    return made[task].cast("int")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, undirected edges, anomalies."""
    return nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("y") > 0).alias("n_anomalies")).join(graph.canonical(edges).agg(F.count("*").alias("n_edges")))

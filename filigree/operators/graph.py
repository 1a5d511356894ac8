"""Graphs as tables: ``edges(src, dst)`` holds both directions, ``nodes(node)`` also the isolated ones.

Every function takes and returns DataFrames. Sets of nodes are ``members(nb, node)``, one row a node, with the
anchor of neighbourhood ``nb`` in a column of its own where it matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.components import components
from filigree.operators.ranks import running


def coalesce(edges: DataFrame) -> DataFrame:
    """Each edge once."""
    return edges.select("src", "dst").distinct()


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once; loops stay."""
    return coalesce(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


def canonical(edges: DataFrame) -> DataFrame:
    """Every undirected edge once, the smaller end first, without loops: the exchange form for other libraries."""
    return drop_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, nbrs``: sorted neighbours without the node itself. A hub's list is one row; joins on edges don't need it."""
    return drop_loops(edges).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``node, nbr`` for the nodes ``of``."""
    return of.select("node").join(edges, F.col("node") == F.col("src")).select("node", F.col("dst").alias("nbr"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree``; 0 for the isolated."""
    counted = drop_loops(edges).groupBy("src").agg(F.count("*").alias("n"))
    return nodes.join(counted, F.col("node") == F.col("src"), "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def validity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, loops, repeated edges, edges without their reverse, ends that are no node or negative."""
    e = edges.select("src", "dst")
    known = nodes.select(F.col("node").alias("k"))
    dangling = e.select(F.explode(F.array("src", "dst")).alias("end")).join(known, F.col("end") == F.col("k"), "left_anti").agg(F.count("*").alias("n_dangling"))
    lonely = e.join(e.select(F.col("dst").alias("s"), F.col("src").alias("d")).distinct(), (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left_anti").agg(F.count("*").alias("n_one_way"))
    sizes = e.groupBy("src", "dst").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"),
        F.count_if(F.col("src") == F.col("dst")).alias("n_loops"),
        F.count_if((F.col("src") < 0) | (F.col("dst") < 0)).alias("n_negative"),
    )
    return nodes.agg(F.count("*").alias("n_nodes")).join(sizes).join(dangling).join(lonely)  # single rows


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``nb, src, dst``: edges of which both ends are in the set; two equi-joins, for all sets at once."""
    m = members.select("nb", "node")
    half = m.join(edges, F.col("node") == F.col("src")).select("nb", "src", "dst")
    return half.join(m.select(F.col("nb").alias("n2"), F.col("node").alias("d2")), (F.col("nb") == F.col("n2")) & (F.col("dst") == F.col("d2"))).select("nb", "src", "dst")


def induced_small(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """``nb, src, dst`` as `induced` gives it, without loops, of sets of a few nodes that are a row each (``nb`` and the array ``neigh``).

    All pairs of a set are looked up among the edges, so the work grows with the squares of the sets and not with the degrees of their nodes.
    """
    one = sets.select("nb", F.explode(F.array_distinct("neigh")).alias("src"), "neigh")
    pairs = one.select("nb", "src", F.explode(F.array_distinct("neigh")).alias("dst")).filter(F.col("src") != F.col("dst"))
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"))
    return pairs.join(e, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d"))).select("nb", "src", "dst")


def with_anchor_loops(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Induced edges with a loop at each anchor (``nb, anchor``)."""
    return edges.select("nb", "src", "dst").unionByName(anchors.select("nb", F.col("anchor").alias("src"), F.col("anchor").alias("dst"))).distinct()


def glass_features(members: DataFrame) -> DataFrame:
    """``nb, node, x``: the two channels [is the anchor, is inside] of members that carry their ``anchor``."""
    return members.select("nb", "node", F.array((F.col("node") == F.col("anchor")).cast("float"), F.lit(1.0).cast("float")).alias("x"))


def relabel(members: DataFrame) -> DataFrame:
    """``nb, node, local``: 0 for the anchor, then by id."""
    order = Window.partitionBy("nb").orderBy((F.col("node") != F.col("anchor")), "node")
    return members.withColumn("local", (F.row_number().over(order) - 1).cast("long")).select("nb", "node", "local")


def relabelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Induced edges in local ids."""
    a = labels.select("nb", F.col("node").alias("src"), F.col("local").alias("lsrc"))
    b = labels.select("nb", F.col("node").alias("dst"), F.col("local").alias("ldst"))
    return edges.join(a, ["nb", "src"]).join(b, ["nb", "dst"]).select("nb", F.col("lsrc").alias("src"), F.col("ldst").alias("dst"))


def offset_union(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """Many graphs (``graph_id, num_nodes``) as one: edges with ids moved by the nodes of the graphs before."""
    moved = running(graphs, ["graph_id"], F.col("num_nodes"), "offset", "offsets")
    return edges.join(moved, "graph_id").select("graph_id", (F.col("src") + F.col("offset")).alias("src"), (F.col("dst") + F.col("offset")).alias("dst"))


def khop(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """``nb, node, hop``: all within ``radius`` steps of each seed ``node``, which names its set ``nb``."""
    reached = seeds.select(F.col("node").alias("nb"), "node", F.lit(0).alias("hop"))
    for r in range(1, radius + 1):
        step = reached.filter(F.col("hop") == r - 1).join(edges, F.col("node") == F.col("src")).select("nb", F.col("dst").alias("node"), F.lit(r).alias("hop"))
        reached = reached.unionByName(step).groupBy("nb", "node").agg(F.min("hop").alias("hop"))
    return reached


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable; isolated nodes are their own."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("component"))


def component_of_anchor(members: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """Members that the anchor reaches within the induced subgraph in at most ``radius`` more steps."""
    inner = induced(edges, members)
    reached = members.filter(F.col("node") == F.col("anchor")).select("nb", "node")
    for _ in range(radius):
        step = reached.join(inner, (reached["nb"] == inner["nb"]) & (F.col("node") == F.col("src"))).select(reached["nb"], F.col("dst").alias("node"))
        reached = reached.union(step).distinct()
    return members.join(reached, ["nb", "node"], "left_semi")


def subgraph_shape(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``nb, n_nodes, n_edges, density, max_degree`` of the induced subgraphs; density is 0 below two nodes."""
    inner = drop_loops(induced(edges, members))
    deg = inner.groupBy("nb", "src").agg(F.count("*").alias("d")).groupBy("nb").agg((F.sum("d") / 2).cast("long").alias("e"), F.max("d").alias("md"))
    n = members.groupBy("nb").agg(F.count("*").alias("n_nodes"))
    full = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    out = n.join(deg, "nb", "left").select("nb", "n_nodes", F.coalesce("e", F.lit(0)).alias("n_edges"), F.coalesce("md", F.lit(0)).alias("max_degree"))
    return out.withColumn("density", F.when(F.col("n_nodes") < 2, 0.0).otherwise(F.col("n_edges") / full))


SHAPES = {
    # i and j: places of two members of a group of n.
    "clique": "true",
    "star": "i = 0",
    "path": "j = i + 1",
    "cycle": "j = i + 1 OR (i = 0 AND j = n - 1)",
    "biclique": "i < n div 2 AND j >= n div 2",
    "tree": "i = (j - 1) div 2",
    "near_clique": "NOT (i = 0 AND j = n - 1)",
}


def inject(nodes: DataFrame, edges: DataFrame, method: str = "clique", n_groups: int = 2, group_size: int = 6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Plant structures: edges with the new ones, and ``node, y``, y being 2 (bit 1) for the nodes that have part.

    Groups are the nodes with the lowest hash, in turn; a group has ``group_size`` nodes and so a bounded number of pairs.
    """
    if method not in SHAPES:
        raise ValueError(f"unknown method {method!r}")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("inject"), F.col("node").cast("string")))
    picked = nodes.select("node", order.alias("h")).orderBy("h", "node").limit(n_groups * group_size)
    place = Window.orderBy("h", "node")
    picked = picked.withColumn("k", F.row_number().over(place) - 1).select("node", F.floor(F.col("k") / group_size).alias("g"), (F.col("k") % group_size).alias("i"))
    other = picked.select(F.col("node").alias("dst"), F.col("g").alias("g2"), F.col("i").alias("j"))
    size = picked.groupBy(F.col("g").alias("g3")).agg(F.count("*").alias("n"))
    pairs = picked.join(other, (F.col("g") == F.col("g2")) & (F.col("i") < F.col("j"))).join(size, F.col("g") == F.col("g3")).filter(F.expr(SHAPES[method]))
    grown = undirected(edges.select("src", "dst").unionByName(pairs.select(F.col("node").alias("src"), "dst")))
    marked = nodes.join(picked.select(F.col("node").alias("p")), F.col("node") == F.col("p"), "left")
    return grown, marked.select("node", F.when(F.col("p").isNotNull(), 2).otherwise(0).alias("y"))

"""The engine's operators as queries over the test tables, and the same in SQL.

All run over whole tables. The graph is that of parts that stand in two or more common orders; its neighbourhoods
are the nodes with all their neighbours. Queries named ``..._whole`` run on the graph of all common orders.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.config import OutlierConfig
from filigree.functions import scoring
from filigree.operators import contain, egos as near, encode, generate, graph, metrics, outliers, patterns, sampling, search, train
from filigree.plans import detect
from filigree.registry import SCORERS
from filigree.session import materialise, remove
from filigree.sources import files, graphs
from filigree.sources.graphs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


# Tables that several queries share, and their SQL.

GRAPH = """
WITH RECURSIVE items AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
pairs AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) >= 2),
edges AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
nodes AS (SELECT DISTINCT src AS node FROM edges),
degrees AS (SELECT src AS node, count(*) AS degree FROM edges GROUP BY src),
members AS (SELECT node AS nb, node AS anchor, node FROM nodes UNION ALL SELECT src, src, dst FROM edges)"""
INNER = (
    GRAPH
    + """,
inner_edges AS (SELECT m.nb, e.src, e.dst FROM members m JOIN edges e ON m.node = e.src JOIN members o ON o.nb = m.nb AND o.node = e.dst)"""
)
COUNTS = (
    INNER
    + """,
inner_degree AS (SELECT m.nb, m.node, m.anchor, count(i.src) AS d FROM members m LEFT JOIN inner_edges i ON m.nb = i.nb AND m.node = i.src GROUP BY ALL),
triangles AS (SELECT nb, count(*) // 2 AS t FROM inner_edges WHERE src <> nb AND dst <> nb GROUP BY nb),
counts AS (
    SELECT nb, anchor, count(*) AS n_nodes, sum(d)::BIGINT // 2 AS n_edges, max(CASE WHEN node = anchor THEN d END) AS anchor_degree, coalesce(any_value(t), 0) AS anchor_triangles,
        sum(d * (d - 1) // 2)::BIGINT AS n_paths2, count(*) FILTER (d >= 2) AS n_deg2, count(*) FILTER (d >= 3) AS n_deg3, max(d) AS max_degree
    FROM inner_degree LEFT JOIN triangles USING (nb) GROUP BY nb, anchor
),
embs AS (SELECT nb, anchor, [ln(1 + n_nodes)::FLOAT, ln(1 + n_edges)::FLOAT, ln(1 + anchor_degree)::FLOAT, ln(1 + anchor_triangles)::FLOAT, ln(1 + n_paths2)::FLOAT, ln(1 + n_deg2)::FLOAT, ln(1 + n_deg3)::FLOAT, ln(1 + max_degree)::FLOAT] AS emb FROM counts),
freqs AS (
    SELECT q.nb AS qid, count(*) FILTER (list_sum(list_transform(list_zip(q.emb, r.emb), lambda p: pow(greatest(p[1]::DOUBLE - p[2]::DOUBLE, 0), 2))) < 1e-9) AS n_contained,
        count(*) FILTER (list_sum(list_transform(list_zip(q.emb, r.emb), lambda p: pow(greatest(p[1]::DOUBLE - p[2]::DOUBLE, 0), 2))) < 1e-9) / count(*)::DOUBLE AS freq
    FROM embs q CROSS JOIN embs r GROUP BY q.nb
)"""
)
BEAMS = (
    GRAPH
    + """,
beams AS (
    SELECT e.src AS start, e.src || ',' || e.dst AS beam, [e.src, e.dst] AS neigh, 2 AS size, b.degree / c.n::DOUBLE AS freq, 2 / c.n::DOUBLE AS weight, b.degree / c.n::DOUBLE AS score,
        a.degree / c.n::DOUBLE AS last_score, ((e.src + e.dst) % 8)::INT AS unchange, e.dst AS node, a.degree / c.n::DOUBLE AS freq0
    FROM edges e JOIN degrees a ON a.node = e.src JOIN degrees b ON b.node = e.dst, (SELECT count(*) AS n FROM nodes) c
),
votes AS (SELECT node, count(*) AS votes FROM beams GROUP BY node)"""
)
SCORED = """
WITH s AS (SELECT d.doc_id AS node, (d.n_chars % 997) / 997.0::DOUBLE AS score, l.toxic AS y FROM documents d JOIN labels l USING (doc_id)),
by_score AS (SELECT score AS threshold, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score),
curve AS (
    SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, (sum(p) OVER w) / (sum(p) OVER ())::DOUBLE AS tpr, (sum(n) OVER w) / (sum(n) OVER ())::DOUBLE AS fpr
    FROM by_score WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)
)"""


#: Common orders that make an edge.
_least: ContextVar[int] = ContextVar("least", default=2)


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written out, as most queries read them several times."""
    edges = materialise(graphs.copurchase(spark, sf_dir, _least.get())[1], "edges")
    return graph.nodes_of(edges), edges


def egos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and members of the neighbourhoods of radius 1."""
    nodes, edges = base(spark, sf_dir)
    return nodes, edges, graph.khop(edges, nodes, 1).select("nb", F.col("nb").alias("anchor"), "node")


def embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = base(spark, sf_dir)
    return nodes, edges, materialise(near.ego_counts(edges).select("nb", "anchor", contain.as_embedding().alias("emb")), "embs")


def beams_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam for every edge, scored by degrees."""
    nodes, edges = base(spark, sf_dir)
    n = nodes.count()
    deg = graph.degree(nodes, edges)
    share = lambda c: F.col(c) / F.lit(float(n))
    b = edges.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("da")), "src").join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("db")), "dst")
    history = F.array(F.struct(F.lit(1).alias("size"), share("da").alias("freq")), F.struct(F.lit(2).alias("size"), share("db").alias("freq")))
    return b.select(
        F.col("src").alias("start"), F.concat_ws(",", "src", "dst").alias("beam"), F.array("src", "dst").alias("neigh"), F.lit(2).alias("size"), share("db").alias("freq"), (F.lit(2) / F.lit(float(n))).alias("weight"),
        share("db").alias("score"), share("da").alias("last_score"), ((F.col("src") + F.col("dst")) % 8).cast("int").alias("unchange"), F.lit(True).alias("original"), F.lit(1.0).alias("density"), F.lit(0.0).alias("gradient"), history.alias("history"),
    )


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("node"), ((F.col("n_chars") % 997) / F.lit(997.0)).alias("score"), F.col("toxic").alias("y"))


# Sources and graphs.


@query(GRAPH + " SELECT src, dst FROM edges")
def edges_undirected(spark, sf):
    return graphs.copurchase(spark, sf, _least.get())[1]


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def edges_coalesced(spark, sf):
    return graph.coalesce(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query(GRAPH + " SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst GROUP BY ALL")
def edges_canonical(spark, sf):
    return graph.canonical(base(spark, sf)[1])


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL")
def self_loop_removal(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.drop_loops(e).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem), n AS (SELECT s_suppkey AS node FROM supplier)
    SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) - count(DISTINCT (src, dst)) FROM e) AS n_repeated,
        (SELECT count(DISTINCT (src, dst)) FILTER (src = dst) FROM e) AS n_loops, 0 AS n_negative,
        (SELECT count(*) FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) WHERE x NOT IN (SELECT node FROM n)) AS n_dangling,
        (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.src = e.dst AND o.dst = e.src)) AS n_one_way"""
)
def edge_validity(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.validity(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")), e)


@query(GRAPH + " SELECT node, degree FROM degrees")
def degree(spark, sf):
    return graph.degree(*base(spark, sf))


@query(GRAPH + " SELECT p_partkey AS node, coalesce(degree, 0) AS degree FROM part LEFT JOIN degrees ON node = p_partkey")
def degree_with_isolated(spark, sf):
    return graph.degree(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), base(spark, sf)[1])


@query(GRAPH + " SELECT degree, count(*) AS n FROM degrees GROUP BY degree")
def degree_hist(spark, sf):
    return graph.degree(*base(spark, sf)).groupBy("degree").agg(F.count("*").alias("n"))


@query(GRAPH + " SELECT src AS node, array_to_string(list_sort(list(dst)), ',') AS nbrs FROM edges GROUP BY src")
def adjacency_list(spark, sf):
    return graph.adjacency(base(spark, sf)[1]).select("node", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query(GRAPH + " SELECT node, dst AS nbr FROM part JOIN nodes ON node = p_partkey JOIN edges ON src = node")
def neighbours(spark, sf):
    of = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    nodes, edges = base(spark, sf)
    return graph.neighbours(edges, of.join(nodes, "node", "left_semi"))


@query(GRAPH + " SELECT nb, node, CASE WHEN nb = node THEN 0 ELSE 1 END AS hop FROM members")
def khop_1(spark, sf):
    nodes, edges = base(spark, sf)
    return graph.khop(edges, nodes, 1)


@query(
    GRAPH
    + """, two AS (SELECT nb, node, CASE WHEN nb = node THEN 0 ELSE 1 END AS hop FROM members UNION ALL SELECT m.nb, e.dst, 2 FROM members m JOIN edges e ON m.node = e.src)
    SELECT nb, node, min(hop) AS hop FROM two GROUP BY nb, node"""
)
def khop_2(spark, sf):
    edges = base(spark, sf)[1]
    out = near.two_hops(edges)
    remove(edges)
    return out


@query(
    GRAPH
    + """, reach AS (SELECT node, node AS r FROM nodes UNION SELECT reach.node, e.dst FROM reach JOIN edges e ON reach.r = e.src)
    SELECT node, min(r) AS component FROM reach GROUP BY node"""
)
def connected_components(spark, sf):
    return graph.connected_components(*base(spark, sf))


@query(INNER + " SELECT nb, src, dst FROM inner_edges")
def induced_edges(spark, sf):
    return near.ego_edges(base(spark, sf)[1])


@query(INNER + " SELECT nb, src, dst FROM inner_edges UNION SELECT node, node, node FROM nodes")
def anchor_self_loops(spark, sf):
    _, edges, m = egos(spark, sf)
    return graph.with_anchor_loops(graph.induced(edges, m), m.select("nb", "anchor").distinct())


@query(COUNTS + " SELECT nb, n_nodes, n_edges, max_degree, round(CASE WHEN n_nodes < 2 THEN 0 ELSE n_edges / (n_nodes * (n_nodes - 1) / 2) END, 9) AS density FROM counts")
def subgraph_shape(spark, sf):
    return near.ego_shape(base(spark, sf)[1]).withColumn("density", F.round(F.col("density").cast("double"), 9))


@query(GRAPH + " SELECT nb, node, CASE WHEN node = anchor THEN 1.0 ELSE 0.0 END::DOUBLE AS is_anchor, 1.0::DOUBLE AS inside FROM members")
def glass_features(spark, sf):
    m = egos(spark, sf)[2]
    return graph.glass_features(m).select("nb", "node", F.col("x")[0].cast("double").alias("is_anchor"), F.col("x")[1].cast("double").alias("inside"))


@query(GRAPH + " SELECT nb, node, row_number() OVER (PARTITION BY nb ORDER BY node <> anchor, node) - 1 AS local FROM members")
def node_relabel(spark, sf):
    return graph.relabel(egos(spark, sf)[2])


@query(
    INNER
    + """, l AS (SELECT nb, node, row_number() OVER (PARTITION BY nb ORDER BY node <> anchor, node) - 1 AS local FROM members)
    SELECT i.nb, a.local AS src, b.local AS dst FROM inner_edges i JOIN l a ON a.nb = i.nb AND a.node = i.src JOIN l b ON b.nb = i.nb AND b.node = i.dst"""
)
def relabelled_edges(spark, sf):
    _, edges, m = egos(spark, sf)
    return graph.relabelled_edges(graph.induced(edges, m), graph.relabel(m))


ORDER_GRAPHS = """WITH l AS (SELECT l_orderkey AS graph_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem),
g AS (SELECT graph_id, count(*) AS num_nodes FROM l GROUP BY graph_id),
e AS (SELECT graph_id, i AS src, i + 1 AS dst FROM l JOIN g USING (graph_id) WHERE i + 1 < num_nodes)"""


def order_graphs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every order is a path of its lines."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.count("*").alias("num_nodes"))
    e = g.filter("num_nodes > 1").select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_nodes") - 2)).alias("src"))
    return g, e.withColumn("dst", F.col("src") + 1)


@query(
    ORDER_GRAPHS
    + """, m AS (SELECT graph_id, coalesce(sum(num_nodes) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM g)
    SELECT graph_id, src + o AS src, dst + o AS dst FROM e JOIN m USING (graph_id)"""
)
def graph_offset_union(spark, sf):
    return graph.offset_union(*order_graphs(spark, sf))


@query(
    """WITH g AS (SELECT o_orderkey AS graph_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders)
    SELECT graph_id, 0 AS y FROM g WHERE y <> 1
    UNION ALL (SELECT graph_id, 2 AS y FROM g WHERE y = 1 ORDER BY md5(concat_ws('|', '42', 'graphs', graph_id::VARCHAR)), graph_id LIMIT 20)"""
)
def molecule_subsample(spark, sf):
    g = table(spark, sf, "orders").select(F.col("o_orderkey").alias("graph_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("y"))
    return graphs.choose_class(g, 1, 20).select("graph_id", "y")


@query(
    """WITH e AS (SELECT l_suppkey AS a, -l_partkey - 1 AS b, l_returnflag AS rel FROM lineitem)
    SELECT DISTINCT a AS src, b AS dst FROM e WHERE rel = 'R' UNION SELECT DISTINCT b, a FROM e WHERE rel = 'R'"""
)
def relation_filter_graph(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"), F.col("l_returnflag").alias("rel"))
    return graph.undirected(graph.drop_loops(e.filter(F.col("rel") == "R")))


@query("WITH e AS (SELECT l_suppkey AS a, -l_partkey - 1 AS b FROM lineitem) SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e")
def merged_relations(spark, sf):
    return graphs.supply(spark, sf)[1]


@query("SELECT doc_id AS node, CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS y, quality <> 0 AS labeled FROM labels")
def binary_labels(spark, sf):
    n = table(spark, sf, "labels").select(F.col("doc_id").alias("node"), F.col("toxic").alias("y"), "quality")
    return graphs.binary_labels(n, unknown=-1).drop("labeled").join(n.select("node", (F.col("quality") != 0).alias("labeled")), "node")


@query("WITH n AS (SELECT doc_id AS node, (1 - quality) + 2 * toxic AS y FROM labels) SELECT node, (y >> 1) & 1 AS structural, y & 1 AS context, (y > 0)::INT AS any_anomaly FROM n")
def label_tasks(spark, sf):
    n = table(spark, sf, "labels").select(F.col("doc_id").alias("node"), (1 - F.col("quality") + 2 * F.col("toxic")).cast("int").alias("y"))
    return n.select("node", graphs.anomaly_label("structural-anomaly").alias("structural"), graphs.anomaly_label("context-anomaly").alias("context"), graphs.anomaly_label("anomaly").alias("any_anomaly"))


@query(GRAPH + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, 0 AS n_anomalies, (SELECT count(*) // 2 FROM edges) AS n_edges")
def dataset_summary(spark, sf):
    nodes, edges = base(spark, sf)
    return graphs.summary(nodes.withColumn("y", F.lit(0)), edges)


@query(
    GRAPH
    + """, p AS (SELECT node, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'inject', node::VARCHAR)), node) - 1 AS k FROM nodes),
    g AS (SELECT node, k // 6 AS g FROM p WHERE k < 12),
    grown AS (SELECT src, dst FROM edges UNION SELECT a.node, b.node FROM g a JOIN g b ON a.g = b.g AND a.node <> b.node)
    SELECT src, dst, src IN (SELECT node FROM g) AND dst IN (SELECT node FROM g) AS planted FROM grown"""
)
def inject_cliques(spark, sf):
    nodes, edges = base(spark, sf)
    grown, y = graph.inject(nodes, edges, "clique", 2, 6)
    hit = y.filter("y = 2").select(F.col("node").alias("p"))
    a, b = hit.withColumnRenamed("p", "pa"), hit.withColumnRenamed("p", "pb")
    return grown.join(a, F.col("src") == F.col("pa"), "left").join(b, F.col("dst") == F.col("pb"), "left").select("src", "dst", (F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("planted"))


# Samples.


@query("SELECT vec_id, label FROM embeddings ORDER BY md5(concat_ws('|', '42', 'refs', vec_id::VARCHAR)), vec_id LIMIT 100")
def reference_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 100, stage="refs")


@query(
    GRAPH
    + """, o AS (SELECT src AS nb, dst AS node, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws('|', '42', 'radial', src::VARCHAR, dst::VARCHAR)), dst) AS r FROM edges)
    SELECT nb, nb AS anchor, node FROM o WHERE r <= 3 UNION ALL SELECT node, node, node FROM nodes"""
)
def radial_subsample(spark, sf):
    return sampling.radial(*base(spark, sf), radius=1, subsample_size=3)


@query(
    GRAPH
    + """, c AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws('|', '42', 'cands', src::VARCHAR, dst::VARCHAR)), dst) AS r FROM edges)
    SELECT src, dst FROM c WHERE r <= greatest(1, round_even(0.5 * n, 0)) AND r <= 4"""
)
def frontier_downsample(spark, sf):
    return sampling.down_sample(base(spark, sf)[1], ["src"], "dst", 0.5, 4)


@query(
    ORDER_GRAPHS
    + """, u AS (SELECT range AS draw, ('0x' || substr(md5('42|graph|' || range), 1, 12))::BIGINT / pow(16, 12) AS u FROM range(1000)),
    c AS (SELECT graph_id, num_nodes, sum(num_nodes) OVER (ORDER BY graph_id ROWS UNBOUNDED PRECEDING) AS upto, sum(num_nodes) OVER () AS total FROM g)
    SELECT draw, graph_id FROM u JOIN c ON u * total < upto AND u * total >= upto - num_nodes"""
)
def weighted_graph_choice(spark, sf):
    return sampling.choose_graphs(order_graphs(spark, sf)[0], 1000)


@query(GRAPH + " SELECT node, (row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'batch', node::VARCHAR)), node) - 1) // 100 AS batch FROM nodes")
def node_batches(spark, sf):
    return sampling.batches(base(spark, sf)[0], 100)


def _tree_sql(multiset: bool, low: int = 2, high: int = 6, n: int = 200) -> str:
    """Growth step by step, as many tables as steps."""
    key = ", m.nb::VARCHAR, e.dst::VARCHAR" + (", e.src::VARCHAR" if multiset else "")
    sql = (
        GRAPH
        + f""", ranked AS (SELECT node, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'start', node::VARCHAR)), node) - 1 AS k FROM nodes),
    m0 AS (SELECT range AS nb, node AS anchor, node, 0 AS step, ('0x' || substr(md5(concat_ws('|', '42', 'size', range::VARCHAR)), 1, 8))::BIGINT % {high - low + 1} + {low} AS size
        FROM range({n}) JOIN ranked ON k = range % (SELECT count(*) FROM nodes))"""
    )
    for k in range(1, high):
        sql += f""",
    p{k} AS (SELECT m.nb, m.anchor, m.size, min({{'h': md5(concat_ws('|', '42', 'grow{k}'{key})), 'to': e.dst}}) AS p FROM m{k - 1} m JOIN edges e ON m.node = e.src
        WHERE m.size > {k} AND NOT EXISTS (SELECT 1 FROM m{k - 1} o WHERE o.nb = m.nb AND o.node = e.dst) GROUP BY ALL),
    m{k} AS (SELECT * FROM m{k - 1} UNION ALL SELECT nb, anchor, p['to'], {k}, size FROM p{k})"""
    return sql + f" SELECT nb, anchor, node, step FROM m{high - 1} QUALIFY count(*) OVER (PARTITION BY nb) = size"


@query(_tree_sql(False))
def tree_sample(spark, sf):
    nodes, edges = base(spark, sf)
    return sampling.tree(nodes, edges, n_neighborhoods=200, min_size=2, max_size=6)


@query(_tree_sql(True))
def tree_fast_sample(spark, sf):
    nodes, edges = base(spark, sf)
    return sampling.tree_fast(nodes, edges, n_neighborhoods=200, min_size=2, max_size=6)


@query()
def tree_sample_default(spark, sf):
    return sampling.tree(*base(spark, sf))


@query()
def tree_fast_sample_default(spark, sf):
    return sampling.tree_fast(*base(spark, sf))


@query(
    GRAPH
    + """, f AS (SELECT src AS nb, dst, md5(concat_ws('|', '42', 'grow1', src::VARCHAR, dst::VARCHAR)) AS h FROM edges)
    SELECT node AS nb, node AS anchor, node, 0 AS step FROM nodes UNION ALL SELECT nb, nb, arg_min(dst, h || lpad(dst::VARCHAR, 20, '0')), 1 FROM f GROUP BY nb"""
)
def growth_step(spark, sf):
    nodes, edges = base(spark, sf)
    return sampling.grow(nodes.select(F.col("node").alias("nb"), F.col("node").alias("anchor"), F.lit(2).alias("size")), edges, "size", 2).drop("size")


# Embeddings and containment.


@query(COUNTS + " SELECT * FROM counts")
def structural_counts(spark, sf):
    return near.ego_counts(base(spark, sf)[1])


@query(COUNTS + " SELECT nb, anchor, " + ", ".join(f"round(emb[{i + 1}]::DOUBLE, 5) AS e{i}" for i in range(8)) + " FROM embs")
def structural_embedding(spark, sf):
    e = embedded(spark, sf)[2]
    return e.select("nb", "anchor", *[F.round(F.col("emb")[i].cast("double"), 5).alias(f"e{i}") for i in range(8)])


VIOLATION = "list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: pow(greatest(p[1]::DOUBLE - p[2]::DOUBLE, 0), 2)))"


@query(f"SELECT q.label, count(*) AS n, round(avg({VIOLATION}), 6) AS mean_violation FROM embeddings q JOIN embeddings r ON q.vec_id + 1 = r.vec_id GROUP BY q.label")
def order_violation_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r_emb"))
    p = contain.violation_pairs(e.select("vec_id", "label", F.col("embedding").alias("q_emb")).join(nxt, "vec_id"))
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("violation"), 6).alias("mean_violation"))


@query(f"SELECT q.vec_id AS qid, count(*) FILTER ({VIOLATION} < 0.5) AS n_contained, round(count(*) FILTER ({VIOLATION} < 0.5) / count(*)::DOUBLE, 9) AS freq FROM embeddings q CROSS JOIN embeddings r GROUP BY q.vec_id")
def containment_freq(spark, sf):
    e = table(spark, sf, "embeddings")
    return contain.frequencies(e, e, 0.5, query_id="vec_id", ref_id="vec_id", emb="embedding").withColumn("freq", F.round("freq", 9))


SAMPLED = f"""WITH refs AS (SELECT vec_id, embedding, label / 10.0::DOUBLE AS f FROM embeddings ORDER BY md5(concat_ws('|', '42', 'refs', vec_id::VARCHAR)), vec_id LIMIT 100),
c AS (SELECT q.vec_id AS qid, count(*) FILTER ({VIOLATION} < 0.8) AS n, max(CASE WHEN {VIOLATION} < 0.8 THEN r.f END) AS max_freq FROM embeddings q CROSS JOIN refs r GROUP BY q.vec_id)"""


def _sampled(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("f", F.col("label") / F.lit(10.0))
    refs = sampling.hash_sample(e, "vec_id", 100, stage="refs")
    return contain.containment_counts(e, refs, 0.8, query_id="vec_id", ref_id="vec_id", emb="embedding", ref_freq="f")


@query(SAMPLED + " SELECT qid, n AS n_contained, max_freq FROM c")
def sampled_freq(spark, sf):
    return _sampled(spark, sf)


@query(SAMPLED + " SELECT qid, CASE WHEN max_freq > 0.5 THEN max_freq ELSE n / 100.0::DOUBLE END AS freq FROM c")
def freq_lower_bound(spark, sf):
    return contain.lower_bounded(_sampled(spark, sf), 100, 0.5)


@query(COUNTS + " SELECT qid, n_contained, round(freq, 9) AS freq FROM freqs")
def graph_containment(spark, sf):
    e = embedded(spark, sf)[2]
    return contain.frequencies(e, e, 1e-9, query_id="nb", ref_id="nb").withColumn("freq", F.round("freq", 9))


@query(COUNTS + " SELECT qid AS anchor, round(min(freq), 9) AS freq FROM freqs WHERE freq <= 0.05 GROUP BY qid")
def freq_outliers(spark, sf):
    return outliers.model_based(embedded(spark, sf)[2], 0.05).withColumn("freq", F.round("freq", 9))


@query(COUNTS + " SELECT round(quantile_cont(freq, 0.26), 9) AS max_freq, 26 AS percentile FROM freqs")
def calibrate_max_freq(spark, sf):
    e = embedded(spark, sf)[2]
    return contain.calibrate(contain.frequencies(e, e, 1e-9, query_id="nb", ref_id="nb"), 7).withColumn("max_freq", F.round("max_freq", 9))


@query(COUNTS + " SELECT round(min(freq), 9) AS low, round(quantile_cont(freq, 0.5), 9) AS mid, round(max(freq), 9) AS high FROM freqs")
def step_summary(spark, sf):
    e = embedded(spark, sf)[2]
    f = contain.frequencies(e, e, 1e-9, query_id="nb", ref_id="nb")
    return f.agg(F.round(F.min("freq"), 9).alias("low"), F.round(F.percentile("freq", F.lit(0.5)), 9).alias("mid"), F.round(F.max("freq"), 9).alias("high"))


@query(COUNTS + " SELECT qid AS anchor, round(freq, 9) AS freq FROM freqs ORDER BY freq, qid LIMIT 25")
def starting_nodes(spark, sf):
    return outliers.starting_nodes(embedded(spark, sf)[2], 25).withColumn("freq", F.round("freq", 9))


def _found(spark, sf) -> list[DataFrame]:
    nodes, edges, e = embedded(spark, sf)
    d = graph.degree(nodes, edges).filter(F.col("degree") >= 4).select(F.col("node").alias("anchor"))
    return [materialise(outliers.model_based(e, 0.05), "found"), d]


@query(COUNTS + " SELECT qid AS anchor FROM freqs WHERE freq <= 0.05 UNION SELECT node FROM degrees WHERE degree >= 4")
def starting_nodes_union(spark, sf):
    return outliers.combine(_found(spark, sf), "union")


@query(COUNTS + " SELECT qid AS anchor FROM freqs WHERE freq <= 0.05 INTERSECT SELECT node FROM degrees WHERE degree >= 4")
def starting_nodes_intersect(spark, sf):
    return outliers.combine(_found(spark, sf), "intersection")


@query(COUNTS + " SELECT qid AS anchor FROM freqs WHERE freq <= 0.05 UNION ALL SELECT node FROM degrees WHERE degree >= 4")
def outlier_embeddings(spark, sf):
    e = embedded(spark, sf)[2]
    return outliers.embeddings_of(_found(spark, sf), e).select("anchor")


@query()
def embedding_projection(spark, sf):
    return files.projected(embedded(spark, sf)[2].select("nb", "emb")).select("nb", F.round(F.abs("x0"), 4).alias("x0"), F.round(F.abs("x1"), 4).alias("x1"))


@query()
def structural_rescoring(spark, sf):
    nodes, edges, m = egos(spark, sf)
    shape = graph.subgraph_shape(m, edges).withColumn("beam", F.col("nb").cast("string"))
    return outliers.structural_rescore(shape.select("beam", (F.col("n_edges") / 100).alias("freq"), "density", F.lit(0.0).alias("gradient"), F.col("n_nodes").alias("size"), "max_degree"))


@query(GRAPH + " SELECT round(0.33::DOUBLE * (15 / count(*)::DOUBLE) + (1 - 0.33::DOUBLE) * (7 / count(*)::DOUBLE), 9) AS max_strength FROM nodes")
def max_strength(spark, sf):
    n = base(spark, sf)[0].count()
    return spark.range(1).select(F.round(scoring.max_strength("weighted", 15.0, 7, n, 0.33), 9).alias("max_strength"))


@query(COUNTS + " SELECT min(nb) AS nb, count(*) AS n FROM embs GROUP BY list_transform(emb, lambda x: round(x::DOUBLE, 6))")
def unique_embeddings(spark, sf):
    e = embedded(spark, sf)[2]
    u = contain.unique_embeddings(e)
    rounded = F.transform("emb", lambda x: F.round(x.cast("double"), 6))
    n = e.groupBy(rounded.alias("k")).agg(F.count("*").alias("n"))
    return u.join(n, F.col("emb") == F.col("k")).select("nb", "n")


@query(COUNTS + " SELECT nb, anchor FROM counts WHERE n_nodes <= 4")
def size_filter(spark, sf):
    m = egos(spark, sf)[2]
    return m.groupBy("nb", "anchor").agg(F.count("*").alias("n")).filter("n <= 4").drop("n")


@query()
def isolation_forest(spark, sf):
    nodes, edges, e = embedded(spark, sf)
    return outliers.isolation_scores(e)


@query()
def isolation_forest_starts(spark, sf):
    nodes, edges, e = embedded(spark, sf)
    return outliers.isolation_forest(e, contamination=0.1)


@query()
def gnn_embedding(spark, sf):
    _, edges, m = egos(spark, sf)
    e = encode.encode(encode.as_rows(m, edges), encode.random_weights())
    return e.select("nb", F.transform("emb", lambda x: F.round(x.cast("double"), 4)).alias("emb"))


# Scores.

LINES = "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS f, l_tax AS w, l_quantity / 50 AS d, l_tax - l_discount AS g, l_quantity / 100 AS last FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round({}, 9) AS score FROM r"
SCORE_SQL = {
    "freq": "f",
    "weighted": "0.33::DOUBLE * f + (1 - 0.33::DOUBLE) * w",
    "harmonic": "CASE WHEN f + w > 0 THEN f * w / (f + w) ELSE 0 END",
    "geometric": "sqrt(f * w)",
    "arithmetic": "(f + w) / 2",
    "density_aware": "CASE WHEN d < 1e-6 THEN f ELSE f / d END",
    "freq_gradient": "f + 0.33::DOUBLE * g",
    "structural": "0.33::DOUBLE * (f / greatest(d, 0.01)) + (1 - 0.33::DOUBLE) * (f + 0.5 * g)",
    "freq_verif": "f + w * (f - last)",
}


def _score(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("freq"), F.col("l_tax").alias("weight"), (F.col("l_quantity") / 50).alias("density"), (F.col("l_tax") - F.col("l_discount")).alias("gradient"), (F.col("l_quantity") / 100).alias("last_score")
        )
        return r.select("l_orderkey", "l_linenumber", "l_partkey", F.round(SCORERS[key](alpha=0.33), 9).alias("score"))

    return run


for _key, _sql in SCORE_SQL.items():
    QUERIES[f"score_{_key}"] = _score(_key)
    ORACLE_SQL[f"score_{_key}"] = LINES.format(_sql)


HISTORY = """WITH h AS (SELECT l_orderkey, l_linenumber AS size, avg(l_discount) AS freq FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, (freq - lag(freq) OVER w) / (size - lag(size) OVER w) AS slope FROM h WINDOW w AS (PARTITION BY l_orderkey ORDER BY size))"""


@query(HISTORY + " SELECT l_orderkey, round(coalesce(avg(slope), 0), 9) + 0 AS gradient FROM s GROUP BY l_orderkey")
def history_gradient(spark, sf):
    h = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("size")).agg(F.avg("l_discount").alias("freq"))
    a = h.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("size", "freq"))).alias("history"))
    return a.select("l_orderkey", F.round(scoring.history_gradient("history"), 9).alias("gradient"))


@query(BEAMS + " SELECT beam, CASE WHEN score >= last_score THEN unchange + 1 ELSE 0 END AS up, CASE WHEN score <= last_score THEN unchange + 1 ELSE 0 END AS down FROM beams")
def unchange_counter(spark, sf):
    return beams_of(spark, sf).select("beam", scoring.unchanged("score", "last_score", "unchange").alias("up"), scoring.unchanged("score", "last_score", "unchange", True).alias("down"))


# Steps of the search.


@query(
    GRAPH
    + """, f AS (SELECT DISTINCT b.src || ',' || b.dst AS beam, e.dst AS node FROM edges b JOIN edges e ON (e.src = b.src OR e.src = b.dst) AND e.dst <> b.src AND e.dst <> b.dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY beam ORDER BY md5(concat_ws('|', '42', 'cands', beam, node::VARCHAR)), node) AS r FROM f)
    SELECT beam, node FROM r WHERE r <= 5"""
)
def gen_candidates(spark, sf):
    return search.candidates(beams_of(spark, sf), base(spark, sf)[1], most=5)


@query(GRAPH + " SELECT DISTINCT b.src || ',' || b.dst AS beam, e.dst AS node FROM edges b JOIN edges e ON (e.src = b.src OR e.src = b.dst) AND e.dst <> b.src AND e.dst <> b.dst")
def frontier(spark, sf):
    return search.candidates(beams_of(spark, sf), base(spark, sf)[1])


@query(BEAMS + " SELECT beam, score, unchange FROM beams WHERE NOT ((score > 0.002 AND unchange > 3) OR score < 0.0006)")
def prune(spark, sf):
    return search.prune(beams_of(spark, sf), 0.0006, 0.002, 3).select("beam", "score", "unchange")


@query(BEAMS + " SELECT beam, score FROM beams WHERE score BETWEEN 0.0006 AND 0.002")
def verify(spark, sf):
    return search.verified(beams_of(spark, sf), 0.0006, 0.002).select("beam", "score")


@query(BEAMS + " SELECT beam, score FROM beams WHERE NOT score BETWEEN 0.0006 AND 0.002")
def verify_remaining(spark, sf):
    return search.remaining(beams_of(spark, sf), 0.0006, 0.002).select("beam", "score")


@query(BEAMS + " SELECT node, votes FROM votes")
def node_votes(spark, sf):
    return search.count_votes(beams_of(spark, sf))


@query(
    BEAMS
    + """, t AS (SELECT b.*, votes, rank() OVER (PARTITION BY start ORDER BY score) AS k FROM beams b JOIN votes v ON v.node = b.node)
    SELECT start, beam, score FROM t WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY start ORDER BY votes DESC, node, beam) <= 2"""
)
def topk_ties(spark, sf):
    b = beams_of(spark, sf)
    return search.keep_tied(b, search.count_votes(b), 2).select("start", "beam", "score")


@query(BEAMS + " SELECT start, beam, score FROM beams QUALIFY row_number() OVER (PARTITION BY start ORDER BY score, node, beam) <= 2")
def topk_plain(spark, sf):
    return search.keep_top(beams_of(spark, sf), 2).select("start", "beam", "score")


@query(BEAMS + " SELECT start, beam, score FROM beams QUALIFY row_number() OVER (PARTITION BY start ORDER BY score - 2 * greatest(0, freq0 - freq), node, beam) <= 2")
def freq_drop_topk(spark, sf):
    return search.keep_top(beams_of(spark, sf), 2, 2.0).select("start", "beam", "score")


@query(BEAMS + " SELECT node AS start, node || ',' || start AS beam, score FROM beams")
def neighbour_copies(spark, sf):
    return search.neighbour_copies(beams_of(spark, sf)).select("start", "beam", "score")


@query(BEAMS + " SELECT node AS anchor, count(*) AS n FROM beams GROUP BY node HAVING count(*) > 2")
def neighbour_promotion(spark, sf):
    return search.promoted(search.neighbour_copies(beams_of(spark, sf)), 2)


@query(BEAMS + " SELECT start, beam, score FROM beams QUALIFY row_number() OVER (PARTITION BY start ORDER BY size, score, beam) = 1")
def verified_dedup(spark, sf):
    return search.first_by_anchor(beams_of(spark, sf)).select("start", "beam", "score")


@query(BEAMS + " SELECT start AS anchor, max(score) AS score FROM beams GROUP BY start")
def best_by_anchor(spark, sf):
    return metrics.best_by_anchor(beams_of(spark, sf).withColumn("anchor", F.col("start")))


@query(GRAPH + " SELECT node FROM nodes WHERE node IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def start_semi_join(spark, sf):
    p = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node"))
    return base(spark, sf)[0].join(p, "node", "left_semi")


@query(GRAPH + " SELECT node FROM nodes WHERE node NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def start_anti_join(spark, sf):
    p = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node"))
    return base(spark, sf)[0].join(p, "node", "left_anti")


def search_starts(embs: DataFrame, num_nodes: int) -> DataFrame:
    """``node``: all anchors that the detector finds, with the limit of `freq_outliers` or that of a detection (`plans.detect`), whichever finds more."""
    found = outliers.model_based(embs, max(0.05, OutlierConfig().max_freq / max(1, num_nodes)))
    return materialise(found.select(F.col("anchor").alias("node")), "starts")


def _search(spark, sf, **options) -> DataFrame:
    _, edges, e = embedded(spark, sf)
    n = e.count()  # one row a node
    starts = search_starts(e, n)
    config = search.SearchConfig(**{"max_strength": 0.25, "max_steps": 5, "max_cands": 8} | options)
    out = search.run(starts, edges, e.select("nb", "emb"), config, n, clean=True)
    return out.select("start", "beam", "size", F.round("freq", 9).alias("freq"), F.round("score", 9).alias("score"))


@query()
def beam_search(spark, sf):
    return _search(spark, sf)


@query()
def beam_search_sampled(spark, sf):
    return _search(spark, sf, sample_size=200, scorer="structural", min_strength=-1.0, max_strength=0.25, add_verified_neighs=True, n_beams=2)


@query()
def beam_json(spark, sf):
    return search.as_json(beams_of(spark, sf))


@query()
def detection(spark, sf):
    from filigree.config import Config, with_overrides

    c = with_overrides(Config(), {"dataset.path": sf, "dataset.injection": "clique", "dataset.task": "structural-anomaly", "search.max_steps": 4, "search.max_cands": 8, "search.sample_size": 300, "outlier.max_freq": 15.0})
    return detect.run(spark, c)["metrics"]


# Patterns.


WL = (
    INNER
    + """, l0 AS (SELECT nb, node, md5(CASE WHEN node = anchor THEN 'a' ELSE 'n' END) AS l FROM members),
    l1 AS (SELECT x.nb, x.node, md5(x.l || coalesce(string_agg(y.l, '' ORDER BY y.l), '')) AS l FROM l0 x LEFT JOIN inner_edges e ON e.nb = x.nb AND e.src = x.node LEFT JOIN l0 y ON y.nb = e.nb AND y.node = e.dst GROUP BY x.nb, x.node, x.l),
    l2 AS (SELECT x.nb, x.node, md5(x.l || coalesce(string_agg(y.l, '' ORDER BY y.l), '')) AS l FROM l1 x LEFT JOIN inner_edges e ON e.nb = x.nb AND e.src = x.node LEFT JOIN l1 y ON y.nb = e.nb AND y.node = e.dst GROUP BY x.nb, x.node, x.l),
    h AS (SELECT nb, count(*) AS size, md5(string_agg(l, '' ORDER BY l)) AS wl_hash FROM l2 GROUP BY nb)"""
)


def _hashes(spark, sf) -> DataFrame:
    return near.ego_hash(base(spark, sf)[1], 2).withColumn("anchor", F.col("nb"))


@query(WL + " SELECT nb, size, wl_hash FROM h")
def wl_hash(spark, sf):
    return _hashes(spark, sf).drop("anchor")


@query(WL + " SELECT size, wl_hash, count(*) AS n FROM h GROUP BY ALL")
def pattern_counts(spark, sf):
    return patterns.pattern_counts(_hashes(spark, sf))


@query(WL + " SELECT count(*) AS n_total, count(DISTINCT (size, wl_hash)) AS n_unique FROM h")
def pattern_totals(spark, sf):
    return patterns.pattern_totals(_hashes(spark, sf))


@query(
    WL
    + """, c AS (SELECT size, wl_hash, count(*) AS n, arg_min(nb, md5(concat_ws('|', '42', 'example', nb::VARCHAR))) AS anchor FROM h GROUP BY size, wl_hash)
    SELECT size, wl_hash, n, anchor FROM c QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, wl_hash) <= 10"""
)
def top_patterns(spark, sf):
    return patterns.top_patterns(_hashes(spark, sf))


# Metrics.


@query(
    SCORED
    + """, c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 0) AS tn, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM s)
    SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 9) AS f1 FROM c"""
)
def confusion(spark, sf):
    s = scored_docs(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return metrics.confusion(s).withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query(SCORED + " SELECT round(threshold, 9) AS threshold, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM curve")
def roc_curve(spark, sf):
    return metrics.roc_curve(scored_docs(spark, sf)).withColumns({c: F.round(c, 9) for c in ("threshold", "tpr", "fpr")})


@query(SCORED + " SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 9) AS auroc FROM (SELECT fpr, tpr, lag(fpr, 1, 0) OVER w AS f0, lag(tpr, 1, 0) OVER w AS t0 FROM curve WINDOW w AS (ORDER BY threshold DESC))")
def auroc(spark, sf):
    return metrics.auroc(scored_docs(spark, sf)).withColumn("auroc", F.round("auroc", 9))


@query(SCORED + " SELECT round(sum((tpr - t0) * tp / (tp + fp)), 9) AS ap FROM (SELECT tp, fp, tpr, lag(tpr, 1, 0) OVER (ORDER BY threshold DESC) AS t0 FROM curve)")
def avg_precision(spark, sf):
    return metrics.average_precision(scored_docs(spark, sf)).withColumn("ap", F.round("ap", 9))


@query(SCORED + " SELECT round(threshold, 9) AS threshold, round(tpr - fpr, 9) AS youden_j, round(1 - threshold, 9) AS optimal_threshold FROM curve ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1")
def youden(spark, sf):
    return metrics.youden(scored_docs(spark, sf)).withColumns({c: F.round(c, 9) for c in ("threshold", "youden_j", "optimal_threshold")})


@query(SCORED + ", v AS (SELECT node, y, score FROM s WHERE score >= 0.5) SELECT d.doc_id AS node, coalesce(v.score, 0) AS score, coalesce(v.y, 0) AS y FROM documents d LEFT JOIN v ON d.doc_id = v.node")
def node_scores(spark, sf):
    v = scored_docs(spark, sf).filter("score >= 0.5")
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    return metrics.node_scores(nodes, v.withColumnRenamed("node", "anchor"), v.filter("y = 1").select("node"))


@query(SCORED + " SELECT node, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 9) AS scaled FROM s")
def min_max_scores(spark, sf):
    return metrics.min_max(scored_docs(spark, sf), "score", "scaled").select("node", F.round("scaled", 9).alias("scaled"))


# Training.

LOSS = f"WITH p AS (SELECT {VIOLATION} AS e, (q.label = r.label)::INT AS y FROM embeddings q JOIN embeddings r ON q.vec_id + 1 = r.vec_id)"


def _loss_pairs(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r_emb"), F.col("label").alias("other"))
    p = e.select("vec_id", "label", F.col("embedding").alias("q_emb")).join(nxt, "vec_id")
    return contain.violation_pairs(p).select("violation", (F.col("label") == F.col("other")).cast("int").alias("label"))


@query(LOSS + " SELECT round(sum(CASE WHEN y = 1 THEN e ELSE greatest(0, 0.9 - e) END), 6) AS loss FROM p")
def order_loss_hinge(spark, sf):
    return train.hinge_loss(_loss_pairs(spark, sf), 0.9).withColumn("loss", F.round("loss", 6))


@query(LOSS + ", l AS (SELECT avg(e) FILTER (y = 1) AS a, avg(ln(1 + exp(0.9 - e))) FILTER (y = 0) AS b FROM p) SELECT round(a, 6) AS positive, round(b, 6) AS negative, round(a + b, 6) AS loss FROM l")
def order_loss_softplus(spark, sf):
    return train.softplus_loss(_loss_pairs(spark, sf), 0.9).withColumns({c: F.round(c, 6) for c in ("positive", "negative", "loss")})


@query(LOSS + " SELECT round(avg(ln(exp(e + 0.1) + exp(0.7 - 2 * e)) - CASE WHEN y = 1 THEN 0.7 - 2 * e ELSE e + 0.1 END), 6) AS loss FROM p")
def classifier_loss(spark, sf):
    return train.classifier_loss(_loss_pairs(spark, sf), (1.0, -2.0), (0.1, 0.7)).withColumn("loss", F.round("loss", 6))


@query(
    LOSS
    + """, s AS (SELECT (e < 0.9)::INT AS pred, y, -e AS score FROM p),
    c AS (SELECT count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 0) AS tn, count(*) FILTER (pred = 0 AND y = 1) AS fn,
        avg(pred) FILTER (y = 1) AS a, avg(1 - pred) FILTER (y = 0) AS b FROM s),
    r AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score),
    u AS (SELECT p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS tall, sum(n) OVER () AS fall FROM r WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT sum(n / fall::DOUBLE * (tp + tp - p) / tall::DOUBLE / 2) AS auroc FROM u)
    SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall,
        round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 9) AS f1, round(a, 9) AS pos_accuracy, round(b, 9) AS neg_accuracy, round(auroc, 9) AS auroc FROM c, g"""
)
def validation_metrics(spark, sf):
    return train.validation(_loss_pairs(spark, sf), 0.9).withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1", "pos_accuracy", "neg_accuracy", "auroc")})


@query()
def generated_graphs(spark, sf):
    return generate.generated(spark, 200)


@query()
def training_pairs(spark, sf):
    p = train.pair_features(generate.pairs(spark, 200))
    return p.select("pair_id", "label", F.round(contain.violation("q_emb", "r_emb"), 9).alias("violation"))


# The same on the graph of parts that stand in any common order, which grows with the tables.

WHOLE = [
    "edges_undirected", "degree", "degree_hist", "adjacency_list", "khop_1", "khop_2", "connected_components", "induced_edges", "subgraph_shape", "structural_counts", "structural_embedding",
    "graph_containment", "freq_outliers", "starting_nodes", "wl_hash", "pattern_counts", "top_patterns", "node_votes", "topk_ties", "beam_search", "beam_search_sampled",
]


def _whole(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        before = _least.set(1)
        try:
            return f(spark, sf)
        finally:
            _least.reset(before)

    return run


for _key in WHOLE:
    QUERIES[f"{_key}_whole"] = _whole(QUERIES[_key])
    if _key in ORACLE_SQL:
        ORACLE_SQL[f"{_key}_whole"] = ORACLE_SQL[_key].replace("GROUP BY ALL HAVING count(*) >= 2", "GROUP BY ALL")

"""Neighbourhoods by triangles and two hops, against the joins of all members, on graphs dealt into many ranges."""

from __future__ import annotations

import numpy as np
import pytest

from filigree import session
from filigree.operators import contain, egos, graph, patterns, sampling, search


def of(spark, pairs):
    e = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")
    return graph.undirected(e).localCheckpoint()


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def random_pairs(n, m, seed):
    r = np.random.default_rng(seed)
    return [(a, b) for a, b in r.integers(0, n, (m, 2)).tolist() if a != b]


GRAPHS = {
    "random": random_pairs(40, 160, 1),
    "far ids": [(a * 3_000_000_000 - 7, b * 3_000_000_000 - 7) for a, b in random_pairs(30, 90, 2)],
    "hub": [(0, k) for k in range(1, 40)] + random_pairs(40, 30, 3),
    "bipartite": [(a, 20 + b) for a in range(12) for b in range(12) if (a * b) % 3],
    "path": [(k, k + 1) for k in range(30)],
    "clique": [(a, b) for a in range(9) for b in range(a)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_egos(spark, name, monkeypatch):
    monkeypatch.setattr(egos, "HELD", 60)
    monkeypatch.setattr(egos.by_triangles, "__defaults__", (60,))
    e = of(spark, GRAPHS[name])
    nodes = graph.nodes_of(e)
    m = graph.khop(e, nodes, 1).selectExpr("nb", "nb AS anchor", "node")
    assert rows(egos.ego_edges(e)) == rows(graph.induced(e, m))
    assert rows(egos.ego_shape(e)) == rows(graph.subgraph_shape(m, e))
    assert rows(egos.ego_counts(e)) == rows(contain.structural_counts(m, e))
    assert rows(egos.ego_hash(e, 2)) == rows(patterns.wl_hash(m, e, 2))
    assert rows(egos.ego_hash(e, 3, False)) == rows(patterns.wl_hash(m, e, 3, False))
    assert rows(egos.two_hops(e, 5)) == rows(graph.khop(e, nodes, 2))


def test_triangles_in_pieces(monkeypatch):
    monkeypatch.setattr(egos, "PATHS", 50)
    pairs = sorted({(min(p), max(p)) for p in random_pairs(60, 500, 4)})
    s, d = (np.array(x) for x in zip(*pairs))
    got = [tuple(sorted(t)) for abc in egos.closed(s, d) for t in zip(*(x.tolist() for x in abc))]
    near = {a: {y for x, y in pairs if x == a} for a in range(60)}
    assert sorted(got) == sorted((a, b, c) for a, b in pairs for c in near[a] & near[b])


def test_small_sets_and_candidates(spark):
    e = of(spark, random_pairs(30, 120, 5))
    sets = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [5]), ("c", [7, 8, 9, 10, 11]), ("d", [1, 1, 2])], "beam string, neigh array<long>")
    members = sets.selectExpr("beam AS nb", "explode(array_distinct(neigh)) AS node")
    assert rows(graph.induced_small(e, sets.withColumnRenamed("beam", "nb"))) == rows(graph.induced(e, members))
    every = search.candidates(sets, e)
    assert rows(search.candidates(sets, e, None, 3)) == rows(sampling.down_sample(every, ["beam"], "node", None, 3))
    assert rows(search.candidates(sets, e, 0.5, 3)) == rows(sampling.down_sample(every, ["beam"], "node", 0.5, 3))


def test_no_row_for_a_path_of_two_edges(spark):
    """A star has a path for each pair of its leaves, and no triangle."""
    n = 3000
    e = of(spark, [(0, k) for k in range(1, n + 1)])
    df = egos.ego_edges(e)
    assert df.count() == 4 * n
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kinds", [1, 2])
def test_triangles_of_edges(monkeypatch, kinds):
    monkeypatch.setattr(egos, "PATHS", 400)
    monkeypatch.setattr(egos, "MARKED", 200)
    pairs = sorted({(min(p), max(p)) for p in random_pairs(60, 500, 4)})
    odd = lambda x: kinds == 2 and x % 3 == 0
    pairs = [(a, b) for a, b in pairs if not (odd(a) and odd(b))]
    s, d = (np.array(x) for x in zip(*pairs))
    u, v, n = egos.supports(s, d, None if kinds == 1 else np.unique(np.concatenate([s, d])) % 3 == 0)
    near = {a: {y for x, y in pairs if x == a} | {x for x, y in pairs if y == a} for a in range(60)}
    kept = lambda *abc: kinds == 1 or sum(map(odd, abc)) == 1
    assert sorted((min(a, b), max(a, b), k) for a, b, k in zip(u.tolist(), v.tolist(), n.tolist())) == [(a, b, sum(kept(a, b, c) for c in near[a] & near[b])) for a, b in pairs]


def test_counts_move_no_row_an_edge(spark):
    """Nodes have a few rows of sums each, and edges none; loops alone make a node without edges."""
    e = of(spark, random_pairs(60, 1500, 6))
    assert egos.edge_sums(e, parts=1).count() == 60
    assert egos.edge_sums(e, 500, 1).count() <= 60 * 5 < e.count()
    assert [(r.nb, r.n_nodes, r.n_edges) for r in egos.ego_counts(spark.createDataFrame([(3, 3)], "src long, dst long")).collect()] == [(3, 1, 0)]


def test_links_of_grown_beams(spark):
    """Beams bring the edges among their members from step to step, with few or all candidates, as a join with all edges finds them."""
    e = of(spark, random_pairs(30, 160, 7))
    sets = spark.createDataFrame([("1", [1]), ("2,3,4", [2, 3, 4])], "beam string, neigh array<long>")
    beams = search.with_links(sets.selectExpr("*", "0D AS score", "size(neigh) AS size"), e)
    for most in (3, None):
        now = beams
        for step in range(3):
            now = search.grown(now, search.candidates(now, e, None, most, step, True))
        now = now.localCheckpoint()
        links = now.selectExpr("beam AS nb", "explode(links) AS l").selectExpr("nb", "l.src", "l.dst")
        assert now.count() > 20
        assert rows(links.union(links.select("nb", "dst", "src"))) == rows(graph.induced_small(e, now.withColumnRenamed("beam", "nb")))
        if most is None:
            break
        beams = now.filter("size = 4").limit(5).drop("last_score")


def test_a_step_joins_edges_once(spark, monkeypatch):
    def never(*_):
        raise AssertionError("edges are joined again")

    e = of(spark, random_pairs(30, 120, 8))
    m = graph.khop(e, graph.nodes_of(e), 1).selectExpr("nb", "nb AS anchor", "node")
    refs = contain.structural_embedding(m, e).select("nb", "emb").localCheckpoint()
    starts = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    config = lambda: search.SearchConfig(max_steps=4, max_strength=1.0, min_strength=0.0, max_cands=4)
    monkeypatch.setattr(graph, "induced_small", never)
    got = rows(search.run(starts, e, refs, config(), 30))
    assert got and got == rows(search.run(starts, e, refs, config(), 30, clean=True))


def test_two_hops_read_edges_in_order(spark):
    """What is packed comes in order, from a table of its own, so the edges given can go."""
    pairs = random_pairs(300, 4000, 9)
    np.random.default_rng(10).shuffle(pairs)
    e = session.materialise(of(spark, pairs).repartition(3, "dst"), "unordered")
    want = rows(graph.khop(e, graph.nodes_of(e), 2))
    got = egos.two_hops(e, 2000)
    session.remove(e)
    assert rows(got) == want

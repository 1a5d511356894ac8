from __future__ import annotations

import itertools
import random

import pytest

from filigree.operators import contain, graph, patterns, sampling, search
from filigree.operators.generate import contains


def edges_of(spark, pairs):
    return graph.undirected(spark.createDataFrame(pairs, "src long, dst long"))


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


PATH = [(0, 1), (1, 2), (2, 3)]
STAR = [(0, i) for i in range(1, 5)]
CYCLE = [(i, (i + 1) % 5) for i in range(5)]
CLIQUE = list(itertools.combinations(range(5), 2))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_undirected_drops_repeats_and_keeps_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3)], "src long, dst long")
    assert rows(graph.undirected(e)) == [(1, 2), (2, 1), (3, 3)]
    assert rows(graph.canonical(e)) == [(1, 2)]
    assert rows(graph.drop_loops(graph.undirected(e))) == [(1, 2), (2, 1)]


def test_degree_counts_isolated_nodes(spark):
    assert rows(graph.degree(nodes_of(spark, [0, 1, 9]), edges_of(spark, [(0, 1)]))) == [(0, 1), (1, 1), (9, 0)]


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src long, dst long")
    n = nodes_of(spark, [4])
    assert rows(graph.degree(n, e)) == [(4, 0)]
    assert rows(graph.khop(e, n, 2)) == [(4, 4, 0)]
    assert rows(graph.connected_components(n, e)) == [(4, 4)]
    assert graph.adjacency(e).count() == 0


def test_validity(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (0, 1), (2, 2), (0, 7), (-1, 0)], "src long, dst long")
    r = graph.validity(nodes_of(spark, [0, 1, 2]), e).head()
    assert (r.n_nodes, r.n_edges, r.n_repeated, r.n_loops, r.n_negative, r.n_dangling, r.n_one_way) == (3, 6, 1, 1, 1, 2, 2)


def test_components(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (5, 6)])
    assert rows(graph.connected_components(nodes_of(spark, [1, 2, 3, 5, 6, 8]), e)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (8, 8)]


def test_long_path_is_one_component(spark):
    e = edges_of(spark, [(i, i + 1) for i in range(200)])
    assert {r.component for r in graph.connected_components(graph.nodes_of(e), e).collect()} == {0}


@pytest.mark.parametrize("pairs,shape", [(PATH, (4, 3, 2, 0.5)), (STAR, (5, 4, 4, 0.4)), (CYCLE, (5, 5, 2, 0.5)), (CLIQUE, (5, 10, 4, 1.0))])
def test_shapes(spark, pairs, shape):
    e = edges_of(spark, pairs)
    m = graph.nodes_of(e).selectExpr("0L AS nb", "node")
    r = graph.subgraph_shape(m, e).head()
    assert (r.n_nodes, r.n_edges, r.max_degree, round(float(r.density), 6)) == shape


def test_density_of_one_node(spark):
    r = graph.subgraph_shape(spark.createDataFrame([(0, 3)], "nb long, node long"), edges_of(spark, PATH)).head()
    assert (r.n_nodes, r.n_edges, r.density) == (1, 0, 0.0)


def test_khop_and_radial(spark):
    e = edges_of(spark, PATH)
    assert rows(graph.khop(e, nodes_of(spark, [0]), 2)) == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    assert sampling.radial(nodes_of(spark, [0, 9]), e, radius=1).filter("nb = 9").count() == 0


def test_tree_samples_are_connected_and_repeatable(spark):
    e = edges_of(spark, CYCLE + [(0, 2), (4, 7), (7, 8)])
    n = graph.nodes_of(e)
    for multiset in (False, True):
        one = rows(sampling.tree(n, e, n_neighborhoods=20, min_size=2, max_size=5, multiset=multiset))
        assert one == rows(sampling.tree(n, e, n_neighborhoods=20, min_size=2, max_size=5, multiset=multiset))
        links = {tuple(r) for r in e.collect()}
        for _, group in itertools.groupby(one, key=lambda r: r[0]):
            got = sorted(group, key=lambda r: r[3])
            assert len({r[2] for r in got}) == len(got)
            for k in range(1, len(got)):
                assert any((got[j][2], got[k][2]) in links for j in range(k))


def test_injection_plants_what_it_marks(spark):
    e = edges_of(spark, [(i, i + 1) for i in range(30)])
    n = graph.nodes_of(e)
    for method in graph.SHAPES:
        grown, y = graph.inject(n, e, method, 2, 4)
        assert y.filter("y = 2").count() == 8
        assert grown.count() > e.count()
    with pytest.raises(ValueError):
        graph.inject(n, e, "wheel")


def random_graph(rng, n, p):
    return {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p}


def test_contained_graphs_have_no_violation(spark):
    rng = random.Random(1)
    pairs, cases = [], []
    for k in range(60):
        n, m = rng.randint(4, 7), rng.randint(2, 4)
        big, small = random_graph(rng, n, 0.5), random_graph(rng, m, 0.6)
        cases.append((k, contains(big, n, small, m)))
        for side, size, es in (("q", m, small), ("r", n, big)):
            for i in range(size):
                pairs.append((f"{k}{side}", f"{k}{side}0", f"{k}{side}{i}", None))
            pairs += [(f"{k}{side}", None, f"{k}{side}{a}", f"{k}{side}{b}") for a, b in es]
    m = spark.createDataFrame([p[:3] for p in pairs if p[3] is None], "nb string, anchor string, node string")
    e = spark.createDataFrame([p[2:] for p in pairs if p[3] is not None], "src string, dst string")
    emb = {r.nb: r.emb for r in contain.structural_embedding(m, graph.undirected(e)).collect()}
    assert any(c for _, c in cases)
    for k, inside in cases:
        v = sum(max(0.0, a - b) ** 2 for a, b in zip(emb[f"{k}q"], emb[f"{k}r"], strict=True))
        if inside:
            assert v == 0


def test_containment_counts_match_brute_force(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.random()) for i in range(80)]
    d = spark.createDataFrame(vectors, "id long, emb array<double>, f double")
    d = d.union(spark.createDataFrame([(99, None, 0.1)], d.schema))
    for tau in (1e-9, 0.3):
        got = {r.qid: (r.n_contained, r.max_freq) for r in contain.containment_counts(d, d, tau, "id", "id", ref_freq="f", query_block=16, ref_block=16).collect()}
        assert len(got) == 80
        for i, q, _ in vectors:
            hits = [f for _, r, f in vectors if sum(max(0, a - b) ** 2 for a, b in zip(q, r, strict=True)) < tau]
            assert got[i] == (len(hits), max(hits))


def test_wl_hash_is_invariant(spark):
    e = edges_of(spark, CYCLE + [(a + 10, b + 10) for a, b in CYCLE] + [(a + 20, b + 20) for a, b in STAR])
    m = [(0, 0, i) for i in range(5)] + [(1, 12, i + 10) for i in range(5)] + [(2, 20, i + 20) for i in range(5)]
    d = spark.createDataFrame(m, "nb long, anchor long, node long")
    h = {r.nb: (r.size, r.wl_hash) for r in patterns.wl_hash(d, e, 5).collect()}
    assert h[0] == h[1] != h[2]
    s = patterns.wl_hash(d, e, 5).selectExpr("size", "wl_hash", "nb AS anchor")
    assert patterns.pattern_totals(s).head() == (3, 2)
    assert patterns.top_patterns(s, 1).head().n == 2


def test_search_finds_the_planted_clique(spark):
    pairs = [(i, (i + 1) % 40) for i in range(40)] + list(itertools.combinations(range(100, 106), 2)) + [(0, 100)]
    e = edges_of(spark, pairs)
    n = graph.nodes_of(e)
    m = graph.khop(e, n, 1).selectExpr("nb", "nb AS anchor", "node")
    refs = contain.structural_embedding(m, e).select("nb", "emb")
    config = search.SearchConfig(max_strength=0.2, max_steps=4, min_steps=1, keep_early=True)
    out = search.run(nodes_of(spark, [101, 103, 20]), e, refs, config, n.count())
    found = {r.start: r for r in out.collect()}
    assert {101, 103} <= set(found)
    assert all(set(r.neigh) <= set(range(100, 106)) | {0} for s, r in found.items() if s > 100)
    assert rows(out.select("start", "beam")) == rows(search.run(nodes_of(spark, [101, 103, 20]), e, refs, config, n.count()).select("start", "beam"))
    one = search.as_json(out, nodes_of(spark, [101])).head().json
    assert '"is_true"' in one and "Infinity" not in one

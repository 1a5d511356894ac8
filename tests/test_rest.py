from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from filigree.config import Config, load_config, with_overrides
from filigree.operators import encode, generate, metrics, outliers, train
from filigree.plans import detect
from filigree.plans.callbacks import Callback
from filigree.registry import CALLBACKS, DETECTORS, GENERATORS, SAMPLERS, SCORERS, SEARCHES, Registry
from filigree.sources import files, graphs, mat


def test_registry():
    r = Registry("thing")
    r.register("a")(lambda: 1)
    with pytest.raises(ValueError):
        r.register("a")(lambda: 2)
    with pytest.raises(KeyError, match="there are a"):
        r["b"]
    assert r.build("a") == 1 and list(r) == ["a"] and "a" in r
    assert set(SCORERS) >= {"freq", "weighted", "harmonic", "geometric", "arithmetic", "density_aware", "freq_gradient", "structural", "freq_verif"}
    assert set(SAMPLERS) >= {"tree", "tree_fast", "radial", "radial_fast"} and set(SEARCHES) == {"strength", "sampled"}
    assert set(DETECTORS) == {"model_based", "isolation_forest"} and "ensemble" in GENERATORS and set(CALLBACKS) >= {"logging", "evaluation", "checkpoint", "visualization"}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("search:\n  max_steps: 5\nseed: 7\n")
    (tmp_path / "e.yaml").write_text("")
    c = load_config(str(tmp_path / "c.yaml"))
    assert (c.search.max_steps, c.seed, load_config(str(tmp_path / "e.yaml"))) == (5, 7, Config())
    d = with_overrides(c, {"search.max_cands": "12", "search.calibrate": "true", "dataset.path": "none", "model.tau": "0.5"})
    assert (d.search.max_cands, d.search.calibrate, d.dataset.path, d.model.tau, c.search.max_cands) == (12, True, None, 0.5, None)
    assert with_overrides(d, {"search.max_cands": "null"}).search.max_cands is None
    assert c.key() != d.key()
    with pytest.raises(KeyError):
        with_overrides(c, {"search.nothing": 1})


def test_metrics_with_ties_and_one_class(spark):
    s = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, y int")
    assert metrics.auroc(s).head().auroc == pytest.approx(0.625)
    assert metrics.average_precision(s).head().ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    one = s.filter("y = 1")
    assert metrics.auroc(one).head().auroc is None
    assert metrics.confusion(one.selectExpr("y", "0 AS pred")).head().precision is None
    flipped = s.selectExpr("-score AS score", "y")
    assert metrics.auroc(s).head().auroc + metrics.auroc(flipped).head().auroc == pytest.approx(1)


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i, [float(x) for x in rng.normal(size=3)], 3) for i in range(300)] + [(999, 999, [9.0, 9.0, 9.0], 3), (1000, 1000, [9.0, 9.0, 9.0], 50)]
    d = spark.createDataFrame(rows, "nb long, anchor long, emb array<double>, size int")
    s = outliers.isolation_scores(d.filter("size < 10"))
    assert s.orderBy("iso_score", ascending=False).head().id == 999
    found = {r.anchor for r in outliers.isolation_forest(d, max_neigh_len=10, contamination=0.02).collect()}
    assert 999 in found and 1000 not in found and len(found) <= 7
    with pytest.raises(ValueError):
        outliers.combine([], "union")
    with pytest.raises(ValueError):
        outliers.combine([d], "either")


def test_generators_make_connected_simple_graphs():
    for key in GENERATORS:
        for seed in range(5):
            edges = GENERATORS[key](12, np.random.default_rng(seed))
            assert all(0 <= a < b < 12 for a, b in edges) and len(generate.pieces(12, edges)) == 1
            assert edges == GENERATORS[key](12, np.random.default_rng(seed))


def test_positive_pairs_are_contained(spark):
    f = train.pair_features(generate.pairs(spark, 60)).collect()
    for r in f:
        v = sum(max(0.0, a - b) ** 2 for a, b in zip(r.q_emb, r.r_emb, strict=True))
        if r.label == 1:
            assert v == 0
    assert {r.label for r in f} == {0, 1}


def test_training_improves_and_saves(spark, tmp_path):
    head, history = train.train(spark, n_pairs=150, rounds=40, path=str(tmp_path / "head.npz"))
    assert history[-1]["auc"] > 0.6 and (head.weights >= 0).all()
    assert np.array_equal(train.Head.load(str(tmp_path / "head.npz")).weights, head.weights)


@pytest.mark.parametrize("conv", ["SAGE", "GIN", "GCN", "graph", "GAT", "gated", "PNA"])
def test_encoder_ignores_order_and_loops(conv):
    skip = "none" if conv == "gated" else None
    w = encode.random_weights(conv=conv)
    x = np.array([[1.0, 1], [0, 1], [0, 1], [0, 1]])
    src, dst = np.array([0, 1, 1, 2, 2, 3]), np.array([1, 0, 2, 1, 3, 2])
    a = encode.forward(x, src, dst, w, 3, conv, skip)
    p = np.array([0, 3, 1, 2])
    b = encode.forward(x, np.append(p[src], 0), np.append(p[dst], 0), w, 3, conv, skip)
    assert np.allclose(a, b) and a.shape == (16,)


def test_attention_by_hand():
    # Node 0 hears 1 and itself with raw scores 1 and -1, which the leak makes -0.2; node 1 has no one but itself.
    w = {"c.lin.weight": np.eye(1), "c.lin.bias": np.array([0.5]), "c.att_src": np.array([1.0]), "c.att_dst": np.array([0.0])}
    x = np.array([[-1.0], [1.0]])
    out = encode.gat(x, np.array([1, 0]), np.array([0, 0]), w, "c")
    a, b = np.exp(1.0), np.exp(-0.2)
    assert np.allclose(out, [[(a - b) / (a + b) + 0.5], [1.5]])


def test_gated_step_by_hand():
    w = encode.random_weights(hidden=3, n_layers=1, conv="gated", seed=5)
    rng = np.random.default_rng(1)
    for name in ("conv0.ih", "conv0.hh"):
        w[f"{name}.bias"] = rng.normal(size=9)
    x = rng.normal(size=(3, 2))
    got = encode.gated(x, np.array([0, 1, 2, 2]), np.array([1, 0, 0, 2]), w, "conv0")
    s = lambda v: 1 / (1 + np.exp(-v))
    state = np.append(x, np.zeros((3, 1)), 1)
    for node, heard in ((0, [1, 2]), (1, [0]), (2, [])):
        m = sum((state[i] @ w["conv0.weight"] for i in heard), np.zeros(3))
        i, h = w["conv0.ih.weight"] @ m + w["conv0.ih.bias"], w["conv0.hh.weight"] @ state[node] + w["conv0.hh.bias"]
        z = s(i[3:6] + h[3:6])
        assert np.allclose(got[node], (1 - z) * np.tanh(i[6:] + s(i[:3] + h[:3]) * h[6:]) + z * state[node])
    with pytest.raises(ValueError, match="skip"):
        encode.gated(np.zeros((3, 6)), np.array([0]), np.array([1]), w, "conv0")
    with pytest.raises(ValueError, match="unknown skip"):
        encode.forward(x, np.array([0]), np.array([1]), w, 1, "gated", "some")


def test_json_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, float("inf")), (2, 0.5), (3, float("nan"))], "i int, x double")
    files.write_json(d, str(tmp_path / "j"))
    assert sorted((r.i, r.x) for r in files.read_json(spark, str(tmp_path / "j"), "i int, x double").collect()) == [(1, None), (2, 0.5), (3, None)]


def test_sources(spark, tmp_path):
    e = spark.createDataFrame([("upu", 0, 1), ("usu", 1, 2)], "rel string, src long, dst long")
    e.write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "node long, label int").write.parquet(str(tmp_path / "nodes.parquet"))
    nodes, edges = graphs.load(spark, "relation", str(tmp_path), relation="upu")
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0)] and nodes.filter("y = 2").count() == 1
    with pytest.raises(ValueError):
        graphs.load(spark, "relation", str(tmp_path), relation="nope")
    with pytest.raises(KeyError):
        graphs.load(spark, "nowhere", str(tmp_path))
    with pytest.raises(ValueError):
        graphs.anomaly_label("odd")
    g = spark.createDataFrame([(0, 2, 0), (1, 3, 1)], "graph_id long, num_nodes long, y int")
    n, u = graphs.union_graph(g, spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "graph_id long, src long, dst long"))
    assert n.count() == 5 and sorted(map(tuple, u.collect())) == [(0, 1), (1, 0), (2, 4), (4, 2)]


def _element(kind: int, data: bytes, order: str) -> bytes:
    if len(data) <= 4 and kind != 14:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(name: str, what: int, shape: tuple[int, int], parts: list[tuple[int, bytes]], order: str) -> bytes:
    head = [(6, struct.pack(order + "II", what, 0)), (5, struct.pack(order + "ii", *shape)), (1, name.encode())]
    return _element(14, b"".join(_element(k, d, order) for k, d in head + parts), order)


@pytest.mark.parametrize("order", ["<", ">"])
def test_matlab_relations(spark, tmp_path, order):
    """Stored places of sparse matrices, whether their values are zero or not; compressed elements aren't padded."""
    ints = lambda *v: (5, struct.pack(f"{order}{len(v)}i", *v))
    upu = _matrix("net_upu", 5, (4, 4), [ints(1, 0, 3, 0), ints(0, 1, 2, 2, 3), (2, b"\1\1\0")], order)  # the fourth row is room that no column uses
    none = _matrix("net_none", 5, (4, 4), [ints(), ints(0, 0, 0, 0, 0), (9, b"")], order)
    label = _matrix("label", 6, (1, 4), [(2, bytes([0, 1, 0, 1]))], order)
    packed = zlib.compress(upu)
    body = label + struct.pack(order + "II", 15, len(packed)) + packed + none + _matrix("note", 4, (1, 1), [(4, b"ab")], order)
    data = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + body
    (tmp_path / "a.mat").write_bytes(data)
    nodes, edges = graphs.load(spark, "mat", str(tmp_path / "a.mat"), relation="upu")
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0)]  # without the loop at 3
    assert [n for n, _ in mat.matrices(data)] == ["label", "net_upu", "net_none"]
    rows, columns = dict(mat.matrices(data))["net_upu"]
    assert (rows.tolist(), columns.tolist()) == ([1, 0, 3], [0, 1, 3])
    assert {r.node: r.y for r in nodes.collect()} == {0: 0, 1: 2, 2: 0, 3: 2}
    with pytest.raises(ValueError, match="no relation"):
        graphs.load(spark, "mat", str(tmp_path / "a.mat"), relation="none")
    for bad in (b"", b"x" * 200, data[:150]):
        with pytest.raises(ValueError):
            list(mat.matrices(bad))


class Broken(Callback):
    def on_step_end(self, **_):
        raise RuntimeError


def test_detection_finds_planted_nodes(spark, tmp_path):
    nodes = spark.range(60).selectExpr("id AS node", "0 AS y")
    edges = spark.range(60).selectExpr("id AS src", "(id + 1) % 60 AS dst")
    nodes.write.parquet(str(tmp_path / "nodes.parquet"))
    edges.write.parquet(str(tmp_path / "edges.parquet"))
    c = with_overrides(Config(), {"dataset.name": "parquet", "dataset.path": str(tmp_path), "dataset.injection": "clique", "dataset.n_groups": 1, "dataset.task": "structural-anomaly", "search.max_steps": 4, "search.max_freq": 12, "search.sample_size": 60, "outlier.max_freq": 10, "output": str(tmp_path / "out")})
    out = detect.run(spark, c)
    r = out["metrics"].head()
    assert r.tp >= 1 and r.precision > 0.5 and r.auroc > 0.6
    assert out["patterns"].count() == out["verified"].count()
    assert spark.read.text(str(tmp_path / "out/anomalies")).count() == out["verified"].count()
    Broken().fire("on_step_end", step=1)
    with pytest.raises(ValueError):
        Broken().fire("on_nothing")


def test_search_starts_are_all_that_the_detector_finds(spark):
    """More rare anchors than any fixed number, and the frequent ones are not among them."""
    from filigree.queries import search_starts

    # Sixty neighbourhoods that rise in one size and fall in the other, so that each is contained in itself alone; 200 small ones that all contain.
    rare = [(i, i, [10.0 + i, 100.0 - i]) for i in range(60)]
    e = spark.createDataFrame(rare + [(i, i, [1.0, 1.0]) for i in range(100, 300)], "nb long, anchor long, emb array<float>")
    assert sorted(r.node for r in search_starts(e, 260).collect()) == list(range(60))


def test_whole_graph_has_pairs_of_one_order(spark, tmp_path):
    from filigree.queries import QUERIES

    lines = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3)], "l_orderkey long, l_partkey long")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = lambda name: sorted((r.src, r.dst) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert pairs("edges_undirected_whole") == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert pairs("edges_undirected") == [(1, 2), (2, 1)]
    assert sorted((r.node, r.degree) for r in QUERIES["degree_whole"](spark, str(tmp_path)).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_checkpoint_is_written_in_training(spark, tmp_path):
    """All hooks of a training are fired, and the callback saves a head that loads."""
    from filigree.operators import train
    from filigree.plans.callbacks import Callback, Checkpoint

    seen = []

    class Told(Callback):
        def on_training_start(self, **what):
            seen.append("start")

        def on_training_step(self, round, **what):
            seen.append(round)

        def on_validation(self, auc, **what):
            seen.append("validation")

        def on_training_end(self, head, **what):
            seen.append("end")

    path = f"{tmp_path}/head.npz"
    head, history = train.train(spark, 40, rounds=6, eval_interval=3, callbacks=[Checkpoint(path, every=2), Told()])
    assert seen == ["start", 1, 2, 3, "validation", 4, 5, 6, "validation", "end"] and len(history) == 2
    assert train.Head.load(path).weights.shape == head.weights.shape


def test_search_tells_its_start_and_removes_its_tables(spark):
    from filigree import session
    from filigree.operators import contain, graph, search
    from filigree.plans.callbacks import Callback

    seen = []

    class Told(Callback):
        def on_search_start(self, starts, **what):
            seen.append(starts.count())

        def on_search_end(self, beams, **what):
            seen.append("end")

    edges = graph.undirected(spark.createDataFrame([(i, (i * 7 + 1) % 20) for i in range(20)] + [(i, i + 1) for i in range(19)], "src long, dst long"))
    nodes = graph.nodes_of(edges)
    members = graph.khop(edges, nodes, 1).selectExpr("nb", "nb anchor", "node")
    embs = contain.structural_embedding(members, edges)
    before = len(session._made)
    out = search.run(nodes.limit(3), edges, embs.select("nb", "emb"), search.SearchConfig(max_strength=0.9, max_steps=3, callbacks=[Told()]), 20)
    assert seen == [3, "end"] and out.count() >= 0
    assert not [p for p in session._made[before:] if "search-" in p and "search-verified" not in p]


def test_kept_tables_follow_their_data(spark, tmp_path):
    from filigree.config import Config
    from filigree.sources import files

    made = []

    def table():
        made.append(1)
        return spark.range(len(made))

    place = f"{tmp_path}/data"
    for want in (1, 1, 2):
        if want == 2 or not made:
            spark.range(want).write.mode("overwrite").parquet(place)
        assert files.kept(spark, "t", Config(seed=77), table, of=place).count() == want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from filigree import session

    conf = {}
    fake = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake)
    fake.sparkContext.master = "local[4]"
    assert session.shared_dir(fake).startswith("file:") and conf


def test_dominance_tree_counts_like_brute_force():
    import numpy as np

    from filigree.operators import contain

    rng = np.random.default_rng(4)
    for d, high in ((2, 4), (5, 3), (8, 9)):
        x, y = rng.integers(0, high, (150, d)).astype(float), rng.integers(0, high, (900, d)).astype(float)
        weight, f = rng.integers(1, 5, 900), rng.random(900)
        for tau in (1e-9, 1.5):
            hit = (np.maximum(x[:, None] - y, 0) ** 2).sum(2) < tau
            n, best = contain.dominated(x, y, weight, f, tau, leaf=16)
            assert (n == hit @ weight).all() and np.array_equal(best, np.where(hit, f, -np.inf).max(1))


def test_containment_in_many_blocks(spark):
    """Blocks that settle a pair by their corners give the same as one block; nulls take no part, equal rows count."""
    import random

    from filigree.operators import contain

    rng = random.Random(8)
    rows = [(i, [float(rng.randint(0, 6)) for _ in range(3)], rng.random()) for i in range(400)] + [(1000, None, 0.5), (None, [0.0, 0.0, 0.0], 0.1)]
    d = spark.createDataFrame(rows, "i long, emb array<double>, f double")
    got = [contain.containment_counts(d, d, 1e-9, query_id="i", ref_id="i", ref_freq="f", query_block=a, ref_block=b).collect() for a, b in ((2048, 16_384), (30, 40))]
    assert sorted(got[0]) == sorted(got[1]) and len(got[0]) == 400
    for r in got[0][:50]:
        q = rows[r.qid][1]
        inside = [x for x in rows if x[1] and all(a <= b for a, b in zip(q, x[1], strict=True))]
        assert r.n_contained == len(inside) and r.max_freq == max(x[2] for x in inside)
    assert contain.containment_counts(d.filter("false"), d, 1e-9, query_id="i", ref_id="i").count() == 0
    assert {r.n_contained for r in contain.containment_counts(d, d.filter("false"), 1e-9, query_id="i", ref_id="i").collect()} == {0}


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from filigree.operators import ranks

    rows = [((i * 37) % 101, i % 5) for i in range(101)]
    d = spark.createDataFrame(rows, "k long, x long")
    want, at = {}, 0
    for k, x in sorted(rows, reverse=True):
        want[k], at = at, at + x
    assert {r.k: r.s for r in ranks.running(d, [F.desc("k")], F.col("x"), "s").collect()} == want
    assert sorted(r.n for r in ranks.numbered(d, ["k"], "n").collect()) == list(range(101))
    assert ranks.running(d.filter("false"), ["k"], F.col("x"), "s").count() == 0

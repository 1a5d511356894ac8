"""Random graphs and training pairs, a graph or pair a row and all rows in parallel.

What is drawn depends on the seed and the row's number alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from filigree.operators.sampling import seeded_rows
from filigree.registry import GENERATORS

Edges = set[tuple[int, int]]


def _put(edges: Edges, a: int, b: int) -> None:
    if a != b:
        edges.add((min(a, b), max(a, b)))


def pieces(n: int, edges: Edges) -> list[list[int]]:
    """Connected components, by their smallest nodes."""
    near: dict[int, list[int]] = {i: [] for i in range(n)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    seen, out = set(), []
    for i in range(n):
        if i in seen:
            continue
        todo, part = [i], []
        seen.add(i)
        while todo:
            x = todo.pop()
            part.append(x)
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out.append(sorted(part))
    return out


def connected(n: int, draw, rng: np.random.Generator, tries: int = 100) -> Edges:
    """A connected draw, or after ``tries`` the last one with its components bridged."""
    edges: Edges = set()
    for _ in range(tries):
        edges = draw()
        if len(pieces(n, edges)) <= 1:
            return edges
    parts = pieces(n, edges)
    for left, right in zip(parts, parts[1:], strict=False):
        _put(edges, int(rng.choice(left)), int(rng.choice(right)))
    return edges


@GENERATORS.register("erdos_renyi")
def erdos_renyi(n: int, rng: np.random.Generator, p_alpha: float = 1.3) -> Edges:
    """Each pair with a probability drawn from a Beta distribution whose mean is log2(n) / n."""
    mean = min(0.99, max(1e-6, math.log2(max(2, n)) / n))
    p = rng.beta(p_alpha, p_alpha / mean - p_alpha)

    def draw() -> Edges:
        a, b = np.triu_indices(n, 1)
        hit = rng.random(len(a)) < p
        return {(int(x), int(y)) for x, y in zip(a[hit], b[hit], strict=True)}

    return connected(n, draw, rng)


@GENERATORS.register("watts_strogatz")
def watts_strogatz(n: int, rng: np.random.Generator, density_alpha: float = 1.3, rewire_alpha: float = 2.0, rewire_beta: float = 2.0) -> Edges:
    """A ring of nodes with their next neighbours, some edges of which are moved."""
    mean = min(0.99, max(1e-6, math.log2(max(2, n)) / n))
    k = max(2, min(n - 1, int(rng.beta(density_alpha, density_alpha / mean - density_alpha) * n)))
    p = rng.beta(rewire_alpha, rewire_beta)

    def draw() -> Edges:
        edges: Edges = set()
        for d in range(1, k // 2 + 1):
            for i in range(n):
                j = (i + d) % n
                if rng.random() < p:
                    j = int(rng.integers(n))
                _put(edges, i, j)
        return edges

    return connected(n, draw, rng)


@GENERATORS.register("barabasi_albert")
def barabasi_albert(n: int, rng: np.random.Generator, max_p: float = 0.2, max_q: float = 0.2) -> Edges:
    """Nodes come one by one, with one of two numbers of links to nodes as likely as they have links; ``max_q`` has no effect."""
    high = max(1, min(n - 1, int(2 * math.log2(max(2, n)))))
    m1, m2 = (int(x) for x in rng.integers(1, high + 1, 2))
    p = min(rng.exponential(20), max_p)

    def draw() -> Edges:
        edges: Edges = set()
        ends = [0]
        for i in range(1, n):
            m = min(i, m1 if rng.random() < p else m2)
            near: set[int] = set()
            while len(near) < m:
                near.add(int(ends[rng.integers(len(ends))]) if rng.random() < 0.9 else int(rng.integers(i)))
            for j in near:
                _put(edges, i, j)
                ends += [i, j]
        return edges

    return connected(n, draw, rng)


@GENERATORS.register("powerlaw_cluster")
def powerlaw_cluster(n: int, rng: np.random.Generator, max_p: float = 0.5) -> Edges:
    """Preferential attachment where a link is followed, with a probability, by one to a neighbour of its end."""
    m = int(rng.integers(1, max(2, min(n, int(2 * math.log2(max(2, n)))))))
    p = rng.uniform(0, max_p)

    def draw() -> Edges:
        edges: Edges = set()
        near: dict[int, list[int]] = {i: [] for i in range(n)}
        ends = list(range(min(m, n)))
        for i in range(min(m, n), n):
            last, k, mine = None, 0, set()
            while k < m and len(mine) < i:
                ok = [x for x in near[last] if x != i and x not in mine] if last is not None and rng.random() < p else []
                j = int(ok[rng.integers(len(ok))]) if ok else int(ends[rng.integers(len(ends))]) if ends else int(rng.integers(i))
                if j in mine or j == i:
                    j = int(rng.choice([x for x in range(i) if x not in mine]))
                mine.add(j)
                last, k = j, k + 1
            for j in mine:
                _put(edges, i, j)
                near[i].append(j)
                near[j].append(i)
                ends += [i, j]
        return edges

    return connected(n, draw, rng)


@GENERATORS.register("ensemble")
def ensemble(n: int, rng: np.random.Generator, generators: tuple[str, ...] = ("erdos_renyi", "watts_strogatz", "barabasi_albert", "powerlaw_cluster"), weights: tuple[float, ...] | None = None) -> Edges:
    """One of several generators, by ``weights``."""
    w = None if weights is None else np.array(weights) / sum(weights)
    return GENERATORS[generators[int(rng.choice(len(generators), p=w))]](n, rng)


def generated(spark: SparkSession, n_graphs: int, sizes: tuple[int, int] = (6, 29), generator: str = "ensemble", seed: int = 42) -> DataFrame:
    """``graph_id, num_nodes, src, dst``: canonical edges of ``n_graphs`` graphs; a graph without edges has one row without ends."""

    def made(i: int):
        rng = np.random.default_rng([seed, i])
        n = int(rng.integers(sizes[0], sizes[1] + 1))
        edges = sorted(GENERATORS[generator](n, rng))
        return [(i, n, a, b) for a, b in edges] or [(i, n, None, None)]

    return seeded_rows(n_graphs, spark, made, "graph_id long, num_nodes int, src long, dst long")


def walk(n: int, edges: Edges, start: int, size: int, rng: np.random.Generator) -> list[int]:
    """A connected set around ``start``: the next node is as likely as it has links into the set."""
    near: dict[int, list[int]] = {i: [] for i in range(n)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = [start]
    while len(out) < size:
        frontier = [y for x in out for y in near[x] if y not in out]
        if not frontier:
            break
        out.append(frontier[int(rng.integers(len(frontier)))])
    return out


def _local(nodes: list[int], edges: Edges) -> Edges:
    at = {x: i for i, x in enumerate(nodes)}
    return {(min(at[a], at[b]), max(at[a], at[b])) for a, b in edges if a in at and b in at}


def contains(big: Edges, n_big: int, small: Edges, n_small: int) -> bool:
    """Whether the small anchored graph is a subgraph of the big one, node 0 on node 0; for small graphs only."""
    near = {i: set() for i in range(n_big)}
    for a, b in big:
        near[a].add(b)
        near[b].add(a)
    want = {i: set() for i in range(n_small)}
    for a, b in small:
        want[a].add(b)
        want[b].add(a)

    def place(k: int, at: dict[int, int]) -> bool:
        if k == n_small:
            return True
        for x in [0] if k == 0 else range(1, n_big):
            if x not in at.values() and all(at[j] in near[x] for j in want[k] if j in at) and place(k + 1, at | {k: x}):
                return True
        return False

    return place(0, {})


def pairs(spark: SparkSession, n_pairs: int, sizes: tuple[int, int] = (5, 29), generator: str = "ensemble", hard_ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """``pair_id, label, side, num_nodes, src, dst``: even pairs are positive, odd ones negative; node 0 is the anchor.

    A positive query is an anchored connected part of its target. A hard negative adds up to five edges that the target does
    not have (and is drawn again, easy, if there are none to add); an easy one has a query from another graph.
    """

    def made(i: int):
        rng = np.random.default_rng([seed, i])
        label = int(i % 2 == 0)

        def target() -> tuple[int, Edges]:
            n = int(rng.integers(sizes[0] + 1, sizes[1] + 2))
            edges = GENERATORS[generator](n, rng)
            order = walk(n, edges, int(rng.integers(n)), n, rng)
            return len(order), _local(order, edges)

        n, edges = target()
        size = int(rng.integers(min(sizes[0], n), n + 1))
        nodes = walk(n, edges, 0, size, rng)
        query, m = _local(nodes, edges), len(nodes)
        if not label:
            free = [(a, b) for a in range(m) for b in range(a + 1, m) if (a, b) not in query]
            if rng.random() < hard_ratio and free:
                for j in rng.permutation(len(free))[: int(rng.integers(1, 6))]:
                    query.add(free[int(j)])
            else:
                m, query = target()
        rows = [(i, label, "target", n, a, b) for a, b in sorted(edges)] + [(i, label, "query", m, a, b) for a, b in sorted(query)]
        return rows

    return seeded_rows(n_pairs, spark, made, "pair_id long, label int, side string, num_nodes int, src long, dst long")

"""Neighbourhoods of radius 1 of all nodes, by the triangles of the graph.

The edges within the neighbourhood of a are those of a and, of each triangle that a stands in, the opposite one. So a list of triangles,
each found once, says what two joins of all members with all edges say, without their rows of every path of two edges.
Edges are ``src, dst`` in both directions, each once; loops take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.session import materialise

#: Edges that a task of `triangles` is to hold, about; edges that are packed at once; paths that are looked up at once; places of the table of `supports`.
HELD, PACKED, PATHS, MARKED = 4_000_000, 1 << 20, 1 << 21, 1 << 24


def closed(s: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triangles of the undirected edges ``s, d``, each of which is there once, by some hundred thousands.

    Every edge points to its end of larger degree, and each pair of edges that leave a node is looked up: first in a table of bits by
    hash, which excludes nearly all pairs without an edge, then among the sorted edges.
    """
    ids = np.unique(np.concatenate([s, d]))
    if not len(ids):
        return
    a, b = np.searchsorted(ids, s), np.searchsorted(ids, d)
    del s, d
    order = np.argsort(np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids)), kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids, a, b = ids[order], rank[a], rank[b]
    del rank, order
    key = np.sort(np.minimum(a, b) * len(ids) + np.maximum(a, b))
    del a, b
    u, v = key // len(ids), key % len(ids)
    bits = max(16, int(len(key) * 8).bit_length())
    slot = lambda k: ((k * -7046029254386353131).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
    table = np.zeros(1 << bits, bool)
    table[slot(key)] = True
    # How many edges of the same node come after each edge.
    after = np.searchsorted(u, u, side="right") - 1 - np.arange(len(u))
    upto = np.cumsum(after)
    begin = 0
    while begin < len(u):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PATHS, side="right")))
        n = after[begin:end]
        first = np.repeat(np.arange(begin, end), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        want = v[first] * len(ids) + v[second]
        may = np.flatnonzero(table[slot(want)])
        want = want[may]
        place = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = may[key[place] == want]
        if len(hit):
            yield ids[u[first[hit]]], ids[v[first[hit]]], ids[v[second[hit]]]
        begin = end


def _cuts(edges: DataFrame, ranges: int) -> np.ndarray:
    """Where ranges of nodes begin that have about equally many edges; at most ``ranges - 1``."""
    if ranges < 2:
        return np.zeros(0, np.int64)
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    # Only the sizes of the ranges hang on where they are cut, so of many edges every sixteenth, by hash, tells that.
    edges = edges.filter((F.xxhash64("src", "dst") % 16 == 0) | F.lit(ranges < 5))
    return np.array(sorted(set(edges.agg(F.percentile_approx(F.col("src").cast("long"), shares, F.lit(10_000))).head()[0] or [])), np.int64)


def _joined(edges: DataFrame, cuts: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of ranges that an edge joins: a row a pair."""
    of = lambda c: sum(((F.col(c) >= x).cast("int") for x in cuts.tolist()), F.lit(0))
    return {(r["i"], r["j"]) for r in edges.groupBy(of("src").alias("i"), of("dst").alias("j")).agg(F.count("*")).collect()}


def _deal(edges: DataFrame, cuts: np.ndarray, goes: dict[tuple[int, int], list[tuple[int, int]]]) -> DataFrame:
    """``task, role, n, s, d, data``: edges, packed and sent to the tasks and roles in them that are named for their pair of ranges."""
    width = len(cuts) + 1
    to = {i * width + j: sorted(x) for (i, j), x in goes.items()}

    def full(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        s, d = (np.concatenate(x) for x in zip(*parts))
        pair = np.searchsorted(cuts, s, side="right") * width + np.searchsorted(cuts, d, side="right")
        order = np.lexsort((d, s, pair))
        s, d, pair = s[order], d[order], pair[order]
        kinds, begins = np.unique(pair, return_index=True)
        for kind, x, y in zip(kinds.tolist(), begins.tolist(), [*begins[1:].tolist(), len(s)]):
            step, low = np.diff(s[x:y], prepend=s[x]), int(d[x:y].min())
            far = d[x:y] - low
            wide = max(step.max(), far.max()) >= 1 << 32
            data = np.concatenate([step, far]).astype(np.int64 if wide else np.uint32).tobytes()
            for task, role in to.get(kind, []):
                row = {"task": pa.int32(), "role": pa.int32(), "n": pa.int32(), "s": pa.int64(), "d": pa.int64(), "data": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((task, role, y - x, int(s[x]), low, data), row.values())], names=list(row))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= PACKED:
                yield from full(parts)
                parts, n = [], 0
        if n:
            yield from full(parts)

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(pack, "task int, role int, n int, s long, d long, data binary")


def _unpacked(table: Iterator[pa.RecordBatch], roles: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ends of the edges of each role."""
    ends: list[tuple[list, list]] = [([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]) for _ in range(roles)]
    for b in table:
        for role, n, s, d, data in zip(*(b.column(c).to_pylist() for c in ("role", "n", "s", "d", "data"))):
            x = np.frombuffer(data, np.int64 if len(data) == 16 * n else np.uint32)
            ends[role][0].append(s + np.cumsum(x[:n], dtype=np.int64))
            ends[role][1].append(d + x[n:].astype(np.int64))
    return [(np.concatenate(s), np.concatenate(d)) for s, d in ends]


def by_triangles(edges: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, held: int = HELD) -> DataFrame:
    """What ``make`` makes of triangles (arrays of their three nodes, in any order), some at a time; each triangle is met once.

    Nodes are dealt into ranges of about equally many edges. A task has the edges between three ranges, of which two or all may be
    the same, so an edge travels once a range; ranges that no edges join make no task. Edges travel packed.
    """
    once = edges.filter(F.col("src") < F.col("dst"))
    cuts = _cuts(edges, int(np.ceil(np.sqrt(6 * once.count() / held))))
    joined = _joined(once, cuts)
    every = range(len(cuts) + 1)
    names = [(i, j, h) for i in every for j in every[i:] for h in every[j:] if (i, j) in joined and (j, h) in joined and (i, h) in joined]
    goes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, (i, j, h) in enumerate(names):
        for pair in {(i, j), (j, h), (i, h)}:
            goes.setdefault(pair, []).append((k, 0))

    def find(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.array(names[key[0].as_py()])
        for abc in closed(*_unpacked(table, 1)[0]):
            if mine[0] != mine[2]:
                # Triangles of fewer ranges are those of another task.
                kept = (np.sort(np.stack([np.searchsorted(cuts, x, side="right") for x in abc]), axis=0) == mine[:, None]).all(0)
                abc = tuple(x[kept] for x in abc)
            if len(abc[0]):
                yield from make(*abc).to_batches(max_chunksize=1 << 16)

    return _deal(once, cuts, goes).groupBy("task").applyInArrow(find, schema)


def two_hops(edges: DataFrame, share: int = 100_000) -> DataFrame:
    """``nb, node, hop``: what `graph.khop` gives for all nodes and a radius of 2.

    A task has the edges that leave one range of nodes and those that reach another, so all paths between the two are in it, and a
    pair of nodes is told once, where it is found. Its edges grow with the root of their number (``share``: that of a pair of ranges).
    Edges are written out in order first, so that packed ones have small steps, and ``edges`` are not read later.
    """
    edges = materialise(edges.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"), "hop-edges")
    e = edges.filter(F.col("src") != F.col("dst"))
    cuts = _cuts(e, int(np.ceil(np.sqrt(e.count() / share))))
    joined = _joined(e, cuts)
    width = len(cuts) + 1
    after: dict[int, set[int]] = {}
    for i, j in joined:
        after.setdefault(i, set()).add(j)
    goes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in joined:
        # As a first step to every range that a second one reaches (and its own, where it tells who is nearer), and as a second step from
        # every range that one comes from.
        goes[i, j] = [(i * width + k, 0) for k in after.get(j, set()) | {j}] + [(h * width + j, 1) for h, to in after.items() if i in to]

    def find(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, m), (n, t) = _unpacked(table, 2)
        if not len(a) or not len(n):
            return
        order = np.lexsort((m, a))
        a, m = a[order], m[order]
        order = np.lexsort((t, n))
        n, t = n[order], t[order]
        ends, at = np.unique(t, return_inverse=True)
        at = at.astype(np.int32)
        begin, end = np.searchsorted(n, m), np.searchsorted(n, m, side="right")
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        seen = np.zeros(len(ends), bool)
        nbs, nodes, total = [], [], 0

        def batch() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(x) for x in nodes])].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(nbs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(nodes)))], names=["nb", "nodes"])

        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
            for p, q in zip(begin[x:y].tolist(), end[x:y].tolist()):
                seen[at[p:q]] = True
            near = np.append(m[x:y], a[x])
            place = np.minimum(np.searchsorted(ends, near), len(ends) - 1)
            seen[place[ends[place] == near]] = False
            got = np.flatnonzero(seen)
            seen[:] = False
            if len(got):
                nbs.append(int(a[x]))
                nodes.append(ends[got])
                total += len(got)
            if total >= 1 << 19:
                yield batch()
                nbs, nodes, total = [], [], 0
        if nbs:
            yield batch()

    far = _deal(e, cuts, goes).groupBy("task").applyInArrow(find, "nb long, nodes array<long>")
    hop = lambda df, node, k: df.select("nb", F.col(node).alias("node"), F.lit(k).alias("hop"))
    own = hop(edges.select(F.col("src").alias("nb")).union(edges.select("dst")).distinct(), "nb", 0)
    return own.union(hop(e.select(F.col("src").alias("nb"), "dst"), "dst", 1)).union(far.select("nb", F.explode("nodes").alias("node"), F.lit(2).alias("hop")))


def _six(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every node of each triangle with the opposite edge in both directions."""
    return np.concatenate([a, a, b, b, c, c]), np.concatenate([b, c, a, c, a, b]), np.concatenate([c, b, c, a, b, a])


def ego_edges(edges: DataFrame) -> DataFrame:
    """``nb, src, dst``: what `graph.induced` gives for the closed neighbourhoods of all nodes."""
    e = edges.filter(F.col("src") != F.col("dst"))
    far = by_triangles(edges, lambda *abc: pa.table(list(_six(*abc)), names=["nb", "src", "dst"]), "nb long, src long, dst long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"))))
    return e.select(F.col("src").alias("nb"), ends.alias("e")).select("nb", F.col("e.s").alias("src"), F.col("e.d").alias("dst")).union(far)


def _counted(*ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(ends), return_counts=True)


def ego_shape(edges: DataFrame) -> DataFrame:
    """What `graph.subgraph_shape` gives for the closed neighbourhoods of all nodes: the anchor has the largest degree."""
    far = by_triangles(edges, lambda *abc: pa.table(list(_counted(*abc)), names=["t_nb", "t"]), "t_nb long, t long").groupBy("t_nb").agg(F.sum("t").alias("t"))
    near = edges.groupBy(F.col("src").alias("nb")).agg(F.count_if(F.col("src") != F.col("dst")).alias("max_degree"))
    n = F.col("max_degree") + 1
    out = near.join(far, F.col("nb") == F.col("t_nb"), "left").select("nb", n.alias("n_nodes"), (F.col("max_degree") + F.coalesce("t", F.lit(0))).alias("n_edges"), "max_degree")
    return out.withColumn("density", F.when(F.col("n_nodes") < 2, 0.0).otherwise(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2)))


def supports(s: np.ndarray, d: np.ndarray, odd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The undirected edges ``s, d``, each of which is there once, in another order and with ends in any, and the triangles that each is in.

    ``odd``: which of `np.unique` of the nodes are of the second of two kinds, of which no two are joined; only triangles that have
    one count then. Every edge points to its end of larger degree. Paths of two edges are looked up among the edges of their first
    node, which are marked in a table of their own, some nodes at a time.
    """
    ids = np.unique(np.concatenate([s, d]))
    size = len(ids)
    if not size:
        return s, d, np.zeros(0, np.int64)
    a, b = np.searchsorted(ids, s), np.searchsorted(ids, d)
    del s, d
    order = np.argsort(np.bincount(a, minlength=size) + np.bincount(b, minlength=size), kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    ids, a, b = ids[order], rank[a], rank[b]
    kind = np.zeros(size, bool) if odd is None else odd[order]
    del rank, order
    key, b = np.minimum(a, b), np.maximum(a, b)
    key *= 2
    key += kind[b]
    key *= size
    key += b
    del a, b
    key.sort()
    v = (key % size).astype(np.int32)
    key //= size
    u = (key // 2).astype(np.int32)
    # A node's edges to nodes that are not odd, then those to odd ones.
    begin = np.searchsorted(key, 2 * np.arange(size + 1, dtype=np.int64)).astype(np.int32)
    middle = np.searchsorted(key, 2 * np.arange(size, dtype=np.int64) + 1).astype(np.int32)
    del key
    low, high = begin[v], begin[1:][v]
    if odd is not None:
        high = np.where(kind[u], middle[v], high)
        low = np.where(kind[u] | kind[v], low, middle[v])
    paths = high - low
    upto = np.cumsum(paths, dtype=np.int64)
    n = np.zeros(len(u), np.int64)
    rows = max(1, MARKED // size)
    marked, place = np.zeros(rows * size, bool), np.empty(rows * size, np.int32)
    x = 0
    while x < len(u):
        node = int(u[x])
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PATHS // 8, side="right")))
        y = min(y, int(begin[min(node + rows, size)]))
        many = paths[x:y]
        total = int(many.sum())
        if total:
            mine = np.arange(begin[node], begin[u[y - 1] + 1], dtype=np.int32)
            at = (u[mine] - node) * size + v[mine]
            marked[at], place[at] = True, mine
            second = np.arange(total, dtype=np.int32) + np.repeat(low[x:y] - (np.cumsum(many) - many).astype(np.int32), many)
            third = np.repeat((u[x:y] - node) * size, many) + v[second]
            hit = np.flatnonzero(marked[third])
            marked[at] = False
            if len(hit):
                first = x + np.searchsorted(np.cumsum(many), hit, side="right")
                np.add.at(n, np.concatenate([first, second[hit], place[third[hit]]]), 1)
        x = y
    return ids[u], ids[v], n


def _packed(s: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted edges from their least ends on, and a number of each, in as few bytes as the largest takes."""
    order = np.lexsort((d, s))
    s, d, n = s[order], d[order], n[order]
    step, far = np.diff(s, prepend=s[0]), d - d.min()
    wide = max(step.max(), far.max()) >= 1 << 32
    kind = np.uint8 if n.max() < 1 << 8 else np.uint16 if n.max() < 1 << 16 else np.int64
    return int(s[0]), int(d.min()), np.concatenate([step, far]).astype(np.int64 if wide else np.uint32).tobytes(), n.astype(kind).tobytes()


def _edge_sums(s: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.Table:
    """Of the nodes of the edges ``s, d``, which may be there several times: the edges, and the sums over them of what `ego_counts` takes of ``n``, the triangles."""
    ids, at = np.unique(np.concatenate([s, d]), return_inverse=True)
    a, b = at[: len(s)], at[len(s) :]
    key = a * len(ids) + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(n[order], first) if len(key) else n
    ends = np.concatenate([a[order][first], b[order][first]])
    of = lambda x: np.bincount(ends, np.concatenate([x, x]), len(ids)).astype(np.int64)
    return pa.table([ids, of(np.ones(len(n))), of(n), of(n * (n + 1) // 2), of(n >= 1), of(n >= 2)], names=["nb", "d", "t", "p", "two", "three"])


def edge_sums(edges: DataFrame, held: int | None = None, parts: int = 4) -> DataFrame:
    """``nb, d, t, p, two, three``, some rows a node: sums over the edges of a node of 1, ``n``, ``n * (n + 1) / 2``, ``n >= 1`` and ``n >= 2``, where ``n`` is the number of triangles of an edge.

    Triangles are found as in `by_triangles`, but a task counts those of its edges and tells a number an edge, packed; a task for
    every pair of ranges (``parts`` for it) adds these. Every edge is told by one task at least, so those without triangles count too.
    """
    once = edges.filter(F.col("src") < F.col("dst"))
    cuts = _cuts(once, int(np.ceil(np.sqrt(6 * once.count() / (held or HELD)))))
    width = len(cuts) + 1
    joined = _joined(once, cuts)
    every = range(width)
    triples = {(i, j, h) for i in every for j in every[i:] for h in every[j:] if (i, j) in joined and (j, h) in joined and (i, h) in joined}
    home = {(i, j): (i, i, j) for i, j in joined}
    names = sorted(triples | set(home.values()))
    goes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, (i, j, h) in enumerate(names):
        for pair in {(i, j), (j, h), (i, h)} & joined:
            # Of two ranges only triangles of both count, and no edges within the second are needed for these.
            if not (i == j < h and pair == (h, h)) and not (i < j == h and pair == (i, i)):
                goes.setdefault(pair, []).append((k, 0))

    def count(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        mine = names[k]
        s, d = _unpacked(table, 1)[0]
        single = (mine[2] if mine[0] == mine[1] else mine[0]) if len(set(mine)) == 2 else None
        odd = None if single is None else np.searchsorted(cuts, np.unique(np.concatenate([s, d])), side="right") == single
        u, v, n = supports(s, d, odd)
        s, d = np.minimum(u, v), np.maximum(u, v)
        pair = np.searchsorted(cuts, s, side="right") * width + np.searchsorted(cuts, d, side="right")
        own = [i * width + j for (i, j), at in home.items() if at == mine]
        told = (n > 0) | np.isin(pair, own)
        s, d, n, pair = s[told], d[told], n[told], pair[told] * parts + s[told] % parts
        order = np.argsort(pair, kind="stable")
        kinds, begins = np.unique(pair[order], return_index=True)
        for part, x, y in zip(kinds.tolist(), begins.tolist(), [*begins[1:].tolist(), len(pair)]):
            for at in range(x, y, PACKED):
                some = order[at : min(y, at + PACKED)]
                row = [part, len(some), *_packed(s[some], d[some], n[some])]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["part", "n", "s", "d", "data", "counts"])

    def add(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[list] = [[], [], []]
        for b in table:
            for n, s, d, data, counts in zip(*(b.column(c).to_pylist() for c in ("n", "s", "d", "data", "counts"))):
                x = np.frombuffer(data, np.int64 if len(data) == 16 * n else np.uint32)
                ends[0].append(s + np.cumsum(x[:n], dtype=np.int64))
                ends[1].append(d + x[n:].astype(np.int64))
                ends[2].append(np.frombuffer(counts, {n: np.uint8, 2 * n: np.uint16}.get(len(counts), np.int64)).astype(np.int64))
        yield from _edge_sums(*(np.concatenate(x) for x in ends)).to_batches(max_chunksize=1 << 16)

    told = _deal(once, cuts, goes).groupBy("task").applyInArrow(count, "part int, n int, s long, d long, data binary, counts binary")
    return told.groupBy("part").applyInArrow(add, "nb long, d long, t long, p long, two long, three long")


def ego_counts(edges: DataFrame) -> DataFrame:
    """What `contain.structural_counts` gives for the closed neighbourhoods of all nodes: a neighbour's degree is one more than its triangles with the anchor."""
    loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").cast("long").alias("nb"), *[F.lit(0).cast("long").alias(c) for c in ("d", "t", "p", "two", "three")])
    far = edge_sums(edges).union(loops).groupBy("nb").agg(*[F.sum(c).alias(c) for c in ("d", "p", "two", "three")], (F.sum("t") / 2).cast("long").alias("t"))
    d = F.col("d")
    return far.select(
        "nb",
        F.col("nb").alias("anchor"),
        (d + 1).alias("n_nodes"),
        (d + F.col("t")).alias("n_edges"),
        d.alias("anchor_degree"),
        F.col("t").alias("anchor_triangles"),
        ((d * (d - 1) / 2).cast("long") + F.col("p")).alias("n_paths2"),
        (F.col("two") + (d >= 2).cast("long")).alias("n_deg2"),
        (F.col("three") + (d >= 3).cast("long")).alias("n_deg3"),
        d.alias("max_degree"),
    )


def _ego_hash(degree: int, ends: np.ndarray, rounds: int, anchored: bool) -> str:
    """Of one neighbourhood: the anchor's degree, and the edges between its neighbours, ends in turn, as `patterns.wl_hash` hashes it."""
    h = lambda x: md5(x.encode()).hexdigest()
    ids, at = np.unique(ends, return_inverse=True)
    near: list[list[int]] = [[] for _ in range(len(ids))]
    one, two = at[0::2].tolist(), at[1::2].tolist()
    for x, y in zip(one, two):
        near[x].append(y)
        near[y].append(x)
    # Neighbours without an edge to another one are all alike.
    bare, anchor, alone = degree - len(ids), h("a" if anchored else "n"), h("n")
    labels = [alone] * len(ids)
    for _ in range(rounds):
        every = "".join(sorted([*labels, *[alone] * bare]))
        labels, anchor, alone = [h(label + "".join(sorted([anchor, *[labels[y] for y in ys]]))) for label, ys in zip(labels, near)], h(anchor + every), h(alone + anchor)
    return h("".join(sorted([anchor, *labels, *[alone] * bare])))


def ego_hash(edges: DataFrame, rounds: int, anchored: bool = True) -> DataFrame:
    """What `patterns.wl_hash` gives for the closed neighbourhoods of all nodes."""

    def links(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.Table:
        nb, ends = np.concatenate([a, b, c]), np.stack([np.concatenate([b, a, a]), np.concatenate([c, c, b])], axis=1)
        order = np.argsort(nb, kind="stable")
        nb, ends = nb[order], ends[order]
        first = np.flatnonzero(np.r_[True, nb[1:] != nb[:-1]])
        return pa.table([pa.array(nb[first]), pa.array(np.zeros(len(first), np.int64)), pa.ListArray.from_arrays(pa.array((np.r_[first, len(nb)] * 2).astype(np.int32)), pa.array(ends.ravel()))], names=["nb", "d", "ends"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d, ends = None, 0, []
        out: list[tuple[int, int, str]] = []

        def done() -> None:
            if now is not None:
                out.append((now, d + 1, _ego_hash(d, np.concatenate(ends) if ends else np.zeros(0, np.int64), rounds, anchored)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["nb", "size", "wl_hash"])

        for b in batches:
            lists = b.column(2)
            for k, (nb, more) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if nb != now:
                    done()
                    now, d, ends = nb, 0, []
                d += more
                if len(x := lists[k].values):
                    ends.append(x.to_numpy(zero_copy_only=False))
            if len(out) >= 4096:
                yield batch()
                out = []
        done()
        yield batch()

    far = by_triangles(edges, links, "nb long, d long, ends array<long>")
    near = edges.groupBy(F.col("src").alias("nb")).agg(F.count_if(F.col("src") != F.col("dst")).alias("d")).select("nb", "d", F.array().cast("array<long>").alias("ends"))
    return near.union(far).repartition("nb").sortWithinPartitions("nb").mapInArrow(label, "nb long, size long, wl_hash string")

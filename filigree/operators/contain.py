"""Order embeddings and the containment join.

An embedding is a vector in which "is contained in" becomes "is at most, in every component". The violation of
q in r is ``sum(max(0, q - r) ** 2)``; q counts as contained if it is under a threshold. The frequency of q is
the share of reference embeddings that contain it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.graph import drop_loops, induced
from filigree.registry import EMBEDDERS
from filigree.session import materialise, remove


def violation(q: str | Column, r: str | Column) -> Column:
    """Of two arrays, in double precision."""
    q, r = (F.col(x) if isinstance(x, str) else x for x in (q, r))
    over = F.zip_with(q, r, lambda a, b: F.greatest(a.cast("double") - b.cast("double"), F.lit(0.0)))
    return F.aggregate(over, F.lit(0.0), lambda s, x: s + x * x)


def violation_pairs(pairs: DataFrame, q: str = "q_emb", r: str = "r_emb") -> DataFrame:
    return pairs.withColumn("violation", violation(q, r))


def threshold_of(weights: tuple[float, float], bias: tuple[float, float]) -> float:
    """The violation under which a two-class linear classifier says "contained"; 0.1 if its weights are equal."""
    return 0.1 if abs(weights[1] - weights[0]) < 1e-12 else (bias[0] - bias[1]) / (weights[1] - weights[0])


STRUCTURAL = ["n_nodes", "n_edges", "anchor_degree", "anchor_triangles", "n_paths2", "n_deg2", "n_deg3", "max_degree"]


@EMBEDDERS.register("structural")
def structural_embedding(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``nb, anchor, emb``: log1p of counts that can only grow when nodes or edges are added to an anchored graph.

    So a graph that contains another one violates it by exactly 0; the reverse need not hold. ``members`` carries ``anchor``.
    """
    return structural_counts(members, edges).select("nb", "anchor", as_embedding().alias("emb"))


def as_embedding() -> Column:
    """Of the columns of ``STRUCTURAL``."""
    return F.array(*[F.log1p(F.col(c).cast("double")).cast("float") for c in STRUCTURAL])


def structural_counts(members: DataFrame, edges: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """``nb, anchor`` and the counts of ``STRUCTURAL`` of each induced subgraph; ``inner`` are its edges without loops where they are known."""
    inner = drop_loops(induced(edges, members)) if inner is None else inner
    deg = inner.groupBy("nb", F.col("src").alias("node")).agg(F.count("*").alias("d"))
    anchors = members.select("nb", "anchor").distinct()
    # Edges between neighbours of the anchor are its triangles.
    near = inner.join(anchors.select(F.col("nb").alias("nb_a"), "anchor"), (F.col("nb") == F.col("nb_a")) & (F.col("src") == F.col("anchor"))).select("nb", F.col("dst").alias("x"))
    left, right = near.select(F.col("nb").alias("nl"), F.col("x").alias("xl")), near.select(F.col("nb").alias("nr"), F.col("x").alias("xr"))
    tri = inner.join(left, (F.col("nb") == F.col("nl")) & (F.col("src") == F.col("xl"))).join(right, (F.col("nb") == F.col("nr")) & (F.col("dst") == F.col("xr")))
    tri = tri.groupBy("nb").agg((F.count("*") / 2).cast("long").alias("t"))
    each = members.select("nb", "node", "anchor").join(deg, ["nb", "node"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    shape = each.groupBy("nb", "anchor").agg(
        F.count("*").alias("n_nodes"),
        (F.sum("d") / 2).cast("long").alias("n_edges"),
        F.max(F.when(F.col("node") == F.col("anchor"), F.col("d"))).alias("anchor_degree"),
        F.sum((F.col("d") * (F.col("d") - 1) / 2).cast("long")).alias("n_paths2"),
        F.count_if(F.col("d") >= 2).alias("n_deg2"),
        F.count_if(F.col("d") >= 3).alias("n_deg3"),
        F.max("d").alias("max_degree"),
    )
    return shape.join(tri, "nb", "left").select("nb", "anchor", *[F.coalesce("t", F.lit(0)).alias(c) if c == "anchor_triangles" else F.col(c) for c in STRUCTURAL])


def dominated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, f: np.ndarray, tau: float, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the weight of the rows of ``y`` that contain it, and their largest ``f`` (-inf without any).

    A dominance tree: rows of ``y`` are halved on their widest component, and a node knows its least and largest values. The
    violation only falls as ``y`` rises, so against the largest values it tells that no row below can contain a query, and against the
    least that all do; what neither settles goes down to the halves, and is compared row by row in the leaves.
    """
    n, best = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)

    def far(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        over = np.maximum(q - r, 0)
        return np.einsum("ij,ij->i", over, over)

    stack = [(np.arange(len(y)), np.arange(len(x)))]
    while stack:
        rows, seekers = stack.pop()
        if not len(rows) or not len(seekers):
            continue
        low, high = y[rows].min(0), y[rows].max(0)
        seekers = seekers[far(x[seekers], high) < tau]
        sure = far(x[seekers], low) < tau
        n[seekers[sure]] += weight[rows].sum()
        best[seekers[sure]] = np.maximum(best[seekers[sure]], f[rows].max())
        seekers = seekers[~sure]
        if len(rows) > leaf:
            wide = int((high - low).argmax())
            order = rows[np.argsort(y[rows, wide], kind="stable")]
            stack += [(order[: len(rows) // 2], seekers), (order[len(rows) // 2 :], seekers)]
            continue
        for r in rows.tolist():
            hit = seekers[far(x[seekers], y[r]) < tau]
            n[hit] += weight[r]
            best[hit] = np.maximum(best[hit], f[r])
    return n, best


def _blocked(df: DataFrame, size: int, label: str) -> tuple[DataFrame, int]:
    """The rows (each ``v`` once) in blocks ``b`` of about ``size`` neighbours in the sum of their components, and how many blocks."""
    df = materialise(df, f"{label}-distinct")
    n = max(1, -(-df.count() // size))
    if n == 1:
        return df.withColumn("b", F.lit(0)), 1
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    dealt = df.withColumns({"_t": total, "_h": F.xxhash64("v")}).repartitionByRange(n, "_t", "_h").drop("_t", "_h").withColumn("b", F.spark_partition_id())
    out = materialise(dealt, label)
    remove(df)
    return out, n


def _boxes(blocked: DataFrame, name: str) -> DataFrame:
    """``{name}b, {name}low, {name}high``: least and largest components of each block, one row a block."""
    each = blocked.select("b", F.posexplode("v").alias("i", "x")).groupBy("b", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda p: p[c])
    return each.groupBy(F.col("b").alias(f"{name}b")).agg(side("low").alias(f"{name}low"), side("high").alias(f"{name}high"))


def containment_counts(
    queries: DataFrame,
    refs: DataFrame,
    tau: float,
    query_id: str = "qid",
    ref_id: str = "rid",
    emb: str = "emb",
    ref_freq: str | None = None,
    query_block: int = 2048,
    ref_block: int = 16_384,
) -> DataFrame:
    """``qid, n_contained`` (and ``max_freq``, the largest ``ref_freq`` that contains it): of every query, 0 included.

    Equal embeddings are one, with the number of references that have it, so work grows with different embeddings. These are
    dealt into blocks of neighbours. The corners of two blocks often tell that no reference of one contains a query of the other, or
    that all do; only the other pairs of blocks meet, and there a `dominated` search compares. Null embeddings and ids take no part.
    """
    q = queries.filter(F.col(emb).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("qid"), F.col(emb).alias("v"))
    r = refs.filter(F.col(emb).isNotNull()).select(F.col(emb).alias("v"), (F.col(ref_freq) if ref_freq else F.lit(None)).cast("double").alias("f"))
    asked, n_q = _blocked(q.select("v").distinct(), query_block, "contain-queries")
    held, n_r = _blocked(r.groupBy("v").agg(F.count("*").alias("n"), F.max("f").alias("f")), ref_block, "contain-refs")

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"v": pd.Series([], dtype=object), "n": np.zeros(0, np.int64), "f": np.zeros(0)})
        x, y = (np.stack(t["v"].to_numpy()).astype(float) for t in (a, b))
        n, f = dominated(x, y, b["n"].to_numpy(), b["f"].fillna(-np.inf).to_numpy(dtype=float), tau)
        return pd.DataFrame({"v": a["v"], "n": n, "f": np.where(np.isfinite(f), f, np.nan)})

    kind = q.schema["v"].dataType.simpleString()
    left, right = asked.select("v", F.col("b").alias("qb")), held.select("v", "n", "f", F.col("b").alias("rb"))
    if n_q * n_r > 1:
        # One row a pair of blocks; blocks are thousands of rows.
        pairs = _boxes(asked, "q").crossJoin(_boxes(held, "r")).filter(violation("qlow", "rhigh") < tau)
        pairs = materialise(pairs.select("qb", "rb", (violation("qhigh", "rlow") < tau).alias("whole")), "contain-pairs")
        whole = held.groupBy(F.col("b").alias("w_b")).agg(F.sum("n").alias("n"), F.max("f").alias("f"))
        whole = pairs.filter("whole").join(whole, F.col("rb") == F.col("w_b")).groupBy(F.col("qb").alias("w_qb")).agg(F.sum("n").alias("n"), F.max("f").alias("f"))
        sure = left.join(whole, F.col("qb") == F.col("w_qb")).select("v", "n", "f")
        open_ = pairs.filter(~F.col("whole"))
        left = left.join(open_.select(F.col("qb").alias("p_qb"), F.col("rb")), F.col("qb") == F.col("p_qb")).drop("p_qb")
        right = right.join(open_.select("qb", F.col("rb").alias("p_rb")), F.col("rb") == F.col("p_rb")).drop("p_rb")
    else:
        left, right, sure = left.withColumn("rb", F.lit(0)), right.withColumn("qb", F.lit(0)), None
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(match, f"v {kind}, n long, f double")
    found = found if sure is None else found.union(sure)
    best = F.max(F.when(~F.isnan("f"), F.col("f")))
    found = materialise(found.groupBy(F.col("v").alias("f_v")).agg(F.sum("n").alias("n"), best.alias("f")), "contain-found")
    remove(asked, held)
    out = q.join(found, F.col("v") == F.col("f_v"), "left")
    return out.select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n_contained"), *([F.col("f").alias("max_freq")] if ref_freq else []))


def frequencies(queries: DataFrame, refs: DataFrame, tau: float, n_refs: int | None = None, **columns) -> DataFrame:
    """``qid, n_contained, freq``: the count over the number of references."""
    emb = F.col(columns.get("emb", "emb"))
    n = refs.filter(emb.isNotNull()).count() if n_refs is None else n_refs
    return containment_counts(queries, refs, tau, **columns).withColumn("freq", F.col("n_contained") / F.lit(float(max(1, n))))


def lower_bounded(counts: DataFrame, m: int, max_strength: float) -> DataFrame:
    """``qid, freq``: where a contained reference is already known to be more frequent than ``max_strength``, its frequency, else the count over ``m``."""
    known = F.col("max_freq") > F.lit(max_strength)
    return counts.select("qid", F.when(known, F.col("max_freq")).otherwise(F.col("n_contained") / F.lit(float(m))).alias("freq"))


def calibrate(freqs: DataFrame, max_steps: int, freq: str = "freq") -> DataFrame:
    """One row: the percentile ``max(1, 40 - 2 * max_steps)`` of the frequencies, and the percentile taken."""
    p = max(1, 40 - 2 * max_steps)
    return freqs.agg(F.percentile(freq, F.lit(p / 100)).alias("max_freq")).withColumn("percentile", F.lit(p))


def unique_embeddings(embs: DataFrame, id_col: str = "nb", digits: int = 6) -> DataFrame:
    """One row for each embedding rounded to ``digits``, that with the smallest id."""
    rounded = F.transform("emb", lambda x: F.round(x.cast("double"), digits))
    return embs.groupBy(rounded.alias("emb")).agg(F.min(id_col).alias(id_col))

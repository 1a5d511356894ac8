"""Detectors that choose the nodes a search starts from."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import contain, metrics
from filigree.registry import DETECTORS


def rare(freqs: DataFrame, threshold: float) -> DataFrame:
    """Rows whose frequency is at most ``threshold``."""
    return freqs.filter(F.col("freq") <= threshold)


@DETECTORS.register("model_based")
def model_based(embs: DataFrame, freq_thresh: float, tau: float = 1e-9, refs: DataFrame | None = None) -> DataFrame:
    """``anchor, freq``: anchors of neighbourhoods (``nb, anchor, emb``) that few references contain."""
    f = contain.frequencies(embs, embs if refs is None else refs, tau, query_id="nb", ref_id="nb")
    kept = rare(f, freq_thresh)
    return embs.join(kept, F.col("nb") == F.col("qid")).groupBy("anchor").agg(F.min("freq").alias("freq"))


EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n values."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """Nested (feature, value, left, right), leaves being (path length added there,)."""
    wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth == 0 or not len(wide):
        return (float(average_path(len(x))),)
    f = int(rng.choice(wide))
    v = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] <= v
    return (f, v, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1))


def _paths(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        t, rows, depth = stack.pop()
        if len(t) == 1:
            out[rows] = depth + t[0]
            continue
        left = x[rows, t[0]] <= t[1]
        stack += [(t[2], rows[left], depth + 1), (t[3], rows[~left], depth + 1)]
    return out


def isolation_scores(rows: DataFrame, id_col: str = "nb", emb: str = "emb", n_trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """``id, iso_score`` (0 to 1, higher: easier to isolate): an isolation forest.

    A tree is grown on the ``sample`` rows of a pool with its lowest hashes, in a task of its own; the forest, of bounded size, goes to the scoring tasks.
    """
    d = rows.filter(F.col(emb).isNotNull()).select(F.col(id_col).alias("id"), F.col(emb).cast("array<double>").alias("v"))
    trees = d.sparkSession.range(n_trees).select(F.col("id").alias("tree"))
    # Trees draw from a pool of as many rows as all of them need, so what is drawn has a bound whatever the size.
    pool = d.withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").limit(n_trees * sample).drop("h")
    n = pool.count()
    share = min(1.0, 4.0 * sample / max(1, n))
    u = F.pmod(F.xxhash64(F.lit(seed), "tree", "id"), F.lit(1 << 30)) / float(1 << 30)
    dealt = pool.join(F.broadcast(trees)).withColumn("u", u).filter(F.col("u") < share)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["u", "id"]).head(sample)
        x = np.stack(part["v"].to_numpy())
        t = int(part["tree"].iloc[0])
        made = _tree(x, np.random.default_rng([seed, t]), max(1, math.ceil(math.log2(max(2, len(x))))))
        return pd.DataFrame({"tree": [t], "made": [repr(made)], "n": [len(x)]})

    got = dealt.groupBy("tree").applyInPandas(fit, "tree long, made string, n long").orderBy("tree").collect()  # n_trees rows of at most 2 * sample nodes
    import ast

    forest = [(ast.literal_eval(r["made"]), r["n"]) for r in got]

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))
        if not len(x) or not forest:
            return pd.Series(np.zeros(len(v)))
        depth = np.mean([_paths(t, x) for t, _ in forest], axis=0)
        return pd.Series(2.0 ** (-depth / max(1e-9, float(np.mean(average_path(np.array([n for _, n in forest])))))))

    return d.select("id", score("v").alias("iso_score"))


@DETECTORS.register("isolation_forest")
def isolation_forest(embs: DataFrame, max_neigh_len: int | None = None, contamination: float = 0.2, n_trees: int = 100, seed: int = 42) -> DataFrame:
    """``anchor, iso_score``: anchors of the most isolated share of the neighbourhoods that have at most ``max_neigh_len`` nodes (``size``)."""
    d = embs.filter(F.col("size") <= max_neigh_len) if max_neigh_len is not None else embs
    s = isolation_scores(d, n_trees=n_trees, seed=seed)
    limit = s.agg(F.percentile("iso_score", F.lit(1 - contamination)).alias("limit"))
    some = s.join(F.broadcast(limit)).filter(F.col("iso_score") > F.col("limit"))  # one row
    return d.join(some, F.col("nb") == F.col("id")).groupBy("anchor").agg(F.max("iso_score").alias("iso_score"))


def combine(found: list[DataFrame], how: str = "union") -> DataFrame:
    """``anchor`` of what several detectors found: in any of them, or in all."""
    if how not in ("union", "intersection"):
        raise ValueError(f"combine is union or intersection, not {how!r}")
    if not found:
        raise ValueError("there is no detector")
    out = found[0].select("anchor")
    for f in found[1:]:
        out = out.union(f.select("anchor")) if how == "union" else out.intersect(f.select("anchor"))
    return out.distinct()


def detect(embs: DataFrame, detectors: list[tuple[str, dict]], how: str = "union") -> DataFrame:
    """Detectors by name with their options, combined."""
    return combine([DETECTORS.build(name, embs, **options) for name, options in detectors], how)


def starting_nodes(embs: DataFrame, n: int, tau: float = 1e-9) -> DataFrame:
    """``anchor, freq``: the ``n`` rarest, ties to the smaller id."""
    f = contain.frequencies(embs, embs, tau, query_id="nb", ref_id="nb")
    return embs.join(f, F.col("nb") == F.col("qid")).groupBy("anchor").agg(F.min("freq").alias("freq")).orderBy("freq", "anchor").limit(n)


def embeddings_of(found: list[DataFrame], embs: DataFrame) -> DataFrame:
    """Embeddings of what each detector found, one after another: an anchor that two found is there twice."""
    out = None
    for f in found:
        part = embs.join(f.select(F.col("anchor").alias("f_anchor")).distinct(), F.col("anchor") == F.col("f_anchor"), "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def structural_rescore(beams: DataFrame, n_trees: int = 200, least: int = 5, seed: int = 42) -> DataFrame:
    """``beam, structural_score``: how easily a beam is isolated by frequency, density, gradient, size and largest degree, moved to [0, 1].

    ``beams`` has these as columns; fewer than ``least`` beams keep no score.
    """
    d = beams.select("beam", F.array(*[F.col(c).cast("double") for c in ("freq", "density", "gradient", "size", "max_degree")]).alias("emb"))
    if d.count() < least:
        return d.select("beam", F.lit(None).cast("double").alias("structural_score"))
    s = isolation_scores(d, id_col="beam", n_trees=n_trees, seed=seed)
    return metrics.min_max(s.select(F.col("id").alias("beam"), "iso_score"), "iso_score", "structural_score").select("beam", "structural_score")

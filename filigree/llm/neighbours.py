"""Approximate nearest neighbours by multi-index hashing.

Rotations learned from a sample turn a vector into a binary code (signs after an iterative quantisation);
the code is split into substrings of eight bits, each with an index of its own. Codes within ``radius`` bits differ in
``radius // substrings`` bits or fewer in at least one substring (pigeonhole), so looking up all
values that near in every substring retrieves every code within the radius. Those that are within it
are ranked again by their vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


@dataclass(frozen=True)
class Coder:
    """``planes``: one column a bit. ``most``: the largest norm, if norms differ enough to matter, else 0."""

    mean: np.ndarray
    planes: np.ndarray
    most: float

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Bytes of the codes of the rows of ``x``.

        The largest inner product is the smallest angle once every vector is given a last component that makes all norms equal; a
        query's is 0.
        """
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        if self.most:
            last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most**2 - norm**2))
            x = np.column_stack([x / norm[:, None] if query else x / self.most, last / self.most])
        else:
            x = x / norm[:, None]
        return np.packbits((x - self.mean) @ self.planes > 0, axis=1)


def learn(sample: np.ndarray, bits: int, most: float, rounds: int = 30, seed: int = 7) -> Coder:
    """Principal axes of the sample, turned by iterative quantisation; as many turns as the bits need."""
    norm = np.sqrt(np.einsum("ij,ij->i", sample, sample))
    x = np.column_stack([sample / most, np.sqrt(np.maximum(0, most**2 - norm**2)) / most]) if most else sample / norm[:, None]
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[:bits].T
    y = (x - mean) @ axes
    rng, planes = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in planes) < bits:
        turn = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(y.T @ np.where(y @ turn > 0, 1.0, -1.0))
            turn = u @ v
        planes.append(axes @ turn)
    return Coder(mean, np.concatenate(planes, 1)[:, :bits], most)


class MultiIndex:
    """For each substring and value, a bit set of the rows whose substring is within ``reach`` bits of it."""

    def __init__(self, codes: np.ndarray, radius: int):
        n, parts = codes.shape
        self.codes, self.words, self.radius = codes, np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -parts % 8)))).view(np.uint64), radius
        near = BYTE_BITS[np.arange(256)[:, None] ^ np.arange(256)] <= radius // parts
        self.sets = np.stack([np.packbits(near[:, codes[:, s]], axis=1) for s in range(parts)])
        self.n = n

    def within(self, code: np.ndarray, least: int) -> np.ndarray:
        """Rows within the radius, in order; if they are fewer than ``least``, within the smallest radius that has as many."""
        found = np.bitwise_or.reduce(self.sets[np.arange(len(code)), code], axis=0)
        rows = np.flatnonzero(np.unpackbits(found, count=self.n))
        word = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        far = np.bitwise_count(self.words[rows] ^ word).sum(1, dtype=np.int64)
        rows = rows[far <= self.radius]
        if len(rows) >= min(least, self.n):
            return rows
        far = np.bitwise_count(self.words ^ word).sum(1, dtype=np.int64)
        return np.flatnonzero(far <= np.partition(far, min(least, self.n) - 1)[min(least, self.n) - 1])


def search(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    bits: int = 256,
    radius: int = 116,
    sample: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    query_block: int = 2048,
    index_block: int = 32_768,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query by inner product, ties to the smaller id.

    Queries are the ``vec_id`` of ``queries``, or all that ``every`` divides. Fitted on the ``sample`` rows with the lowest hash of
    their ids; every row is indexed. Vectors that are null, zero, not finite, or not of the sample's most
    frequent length take no part, nor do null ids; of rows that share an id, the smallest vector counts.
    Blocks of queries meet blocks of the index; both are bounded, and counted out beforehand. Fewer than
    ``k`` other vectors give all of them; no vectors, no rows.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sane = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sane).groupBy("vec_id").agg(F.min("v").alias("v"))
    schema = "query_id long, vec_id long, score double"
    taken = v.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(sample).toPandas()["v"]
    if not len(taken):
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = int(taken.map(len).mode()[0])
    v = v.filter(F.size("v") == length)
    norms = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = v.agg(F.count("*").alias("n"), F.min(norms).alias("low"), F.max(norms).alias("high"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).head()
    coder = learn(np.stack([np.asarray(x, float) for x in taken if len(x) == length]), bits, facts["high"] if facts["low"] < 0.999 * facts["high"] else 0.0)
    asked = v.filter(F.col("vec_id") % every == 0) if queries is None else v.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    n_q = max(1, -(-(facts["q"] if queries is None else facts["n"]) // query_block))
    n_i = max(1, -(-facts["n"] // index_block))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    left = asked.select("vec_id", "v", spread(n_q, "q").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))).alias("ib"))
    right = v.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), spread(n_i, "i").alias("ib"))

    def match(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(c):
            return none
        order = np.argsort(c["vec_id"].to_numpy(), kind="stable")
        ids, x = c["vec_id"].to_numpy()[order], np.stack(c["v"].to_numpy())[order]
        y = np.stack(q["v"].to_numpy())
        index, out = MultiIndex(coder.codes(x), radius), []
        for query, vector, code in zip(q["vec_id"].to_numpy(), y, coder.codes(y, query=True), strict=True):
            rows = index.within(code, k + 1)
            rows = rows[ids[rows] != query]
            scores = (x[rows] * vector).sum(1)  # summed row by row in one order, so that equal vectors have equal scores
            if len(rows) > k:
                scores_at = np.partition(scores, len(rows) - k)[len(rows) - k]
                near = scores >= scores_at
                rows, scores = rows[near], scores[near]
            best = np.lexsort((ids[rows], -scores))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[rows[best]], "score": scores[best]}))
        return pd.concat(out)

    found = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(match, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

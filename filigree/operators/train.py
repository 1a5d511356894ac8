"""Training of an order embedding on pairs, and its losses as aggregates.

The trained head is a map with weights that are not negative over the structural counts, so containment still gives a violation
of 0; training chooses which counts matter. Pairs are made and measured by Spark, the head is fitted on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import contain, generate, metrics
from filigree.registry import CALLBACKS, EMBEDDERS


def hinge_loss(pairs: DataFrame, margin: float = 0.1, e: str = "violation", label: str = "label") -> DataFrame:
    """One row: violations of the positive pairs, and what the negative ones lack to the margin."""
    return pairs.agg(F.sum(F.when(F.col(label) == 1, F.col(e)).otherwise(F.greatest(F.lit(0.0), F.lit(margin) - F.col(e)))).alias("loss"))


def softplus_loss(pairs: DataFrame, margin: float = 0.1, e: str = "violation", label: str = "label") -> DataFrame:
    """One row: the mean violation of positives and the mean softplus of what negatives lack, and their sum."""
    pos = F.avg(F.when(F.col(label) == 1, F.col(e)))
    neg = F.avg(F.when(F.col(label) == 0, F.log1p(F.exp(F.lit(margin) - F.col(e)))))
    return pairs.agg(pos.alias("positive"), neg.alias("negative")).withColumn("loss", F.coalesce("positive", F.lit(0.0)) + F.coalesce("negative", F.lit(0.0)))


def classifier_loss(pairs: DataFrame, weights: tuple[float, float], bias: tuple[float, float], e: str = "violation", label: str = "label") -> DataFrame:
    """One row: the mean negative log-likelihood of a two-class linear classifier of the violation."""
    a, b = (F.lit(weights[i]) * F.col(e) + F.lit(bias[i]) for i in (0, 1))
    top = F.greatest(a, b)
    total = top + F.log(F.exp(a - top) + F.exp(b - top))
    return pairs.agg(F.avg(total - F.when(F.col(label) == 1, b).otherwise(a)).alias("loss"))


def validation(pairs: DataFrame, tau: float, e: str = "violation", label: str = "label") -> DataFrame:
    """One row: the confusion metrics of ``violation < tau``, accuracies by class, and the area under the curve of -violation."""
    s = pairs.select((F.col(e) < tau).cast("int").alias("pred"), F.col(label).alias("y"), (-F.col(e)).alias("score"))
    parts = s.agg(
        F.avg(F.when(F.col("y") == 1, F.col("pred"))).alias("pos_accuracy"),
        F.avg(F.when(F.col("y") == 0, 1 - F.col("pred"))).alias("neg_accuracy"),
    )
    return metrics.confusion(s).join(parts).join(metrics.auroc(s))  # single rows


def pair_features(pairs: DataFrame) -> DataFrame:
    """``pair_id, label, q_emb, r_emb``: structural embeddings of queries and targets of `generate.pairs`."""
    key = F.concat_ws("-", F.col("pair_id").cast("string"), F.col("side"))
    named = pairs.withColumn("nb", key)
    ids = named.select("nb", "pair_id", "label", "side", "num_nodes").distinct()
    # Ends are made unique over all graphs, so that one edge table serves all.
    wide = lambda c: F.concat_ws("-", F.col("nb"), F.col(c).cast("string"))
    members = ids.select("nb", F.concat_ws("-", F.col("nb"), F.lit("0")).alias("anchor"), F.explode(F.sequence(F.lit(0), F.col("num_nodes") - 1)).alias("i")).withColumn("node", wide("i")).drop("i")
    edges = named.select(wide("src").alias("src"), wide("dst").alias("dst"))
    edges = edges.union(edges.select("dst", "src")).distinct()
    emb = contain.structural_embedding(members, edges).select("nb", "emb")
    both = ids.join(emb, "nb")
    q = both.filter(F.col("side") == "query").select("pair_id", "label", F.col("emb").alias("q_emb"))
    return q.join(both.filter(F.col("side") == "target").select("pair_id", F.col("emb").alias("r_emb")), "pair_id")


@dataclass
class Head:
    """``weights``: one row an output, none negative."""

    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, float) @ self.weights.T

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        np.savez(path, weights=self.weights)

    @classmethod
    def load(cls, path: str) -> Head:
        return cls(np.load(path)["weights"])


def train(spark: SparkSession, n_pairs: int = 2000, output: int = 16, rounds: int = 200, margin: float = 0.1, lr: float = 0.05, eval_interval: int = 20, clip: float = 1.0, path: str | None = None, seed: int = 42, callbacks: list = (), **options) -> tuple[Head, list[dict]]:
    """A head and its history: Adam on the softplus loss, validated on a fifth of the pairs, the best by area under the curve kept (and saved).

    ``callbacks`` are told of the start, every round with its head, every validation, and the end.
    """
    tell = [CALLBACKS.build(c) if isinstance(c, str) else c for c in callbacks]
    for t in tell:
        t.fire("on_training_start", n_pairs=n_pairs, rounds=rounds)
    rows = pair_features(generate.pairs(spark, n_pairs, seed=seed, **options)).orderBy("pair_id").collect()  # n_pairs rows
    q, r = (np.array([x[c] for x in rows], float) for c in ("q_emb", "r_emb"))
    y = np.array([x["label"] for x in rows])
    test = np.arange(len(y)) % 5 == 4
    w = np.abs(np.random.default_rng(seed).normal(size=(output, q.shape[1]))) / q.shape[1]
    m, v, best, history = np.zeros_like(w), np.zeros_like(w), (-1.0, w), []
    d = q - r
    for k in range(1, rounds + 1):
        over = np.maximum(d[~test] @ w.T, 0)
        e = (over**2).sum(1)
        pos = y[~test] == 1
        g = np.where(pos, 1 / max(1, pos.sum()), -1 / (1 + np.exp(np.clip(e - margin, -30, 30))) / max(1, (~pos).sum()))
        grad = (2 * over * g[:, None]).T @ d[~test]
        grad *= min(1.0, clip / (np.linalg.norm(grad) + 1e-12))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = np.maximum(w - lr * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9), 0)
        for t in tell:
            t.fire("on_training_step", round=k, head=Head(w))
        if k % eval_interval == 0 or k == rounds:
            e = (np.maximum(d[test] @ w.T, 0) ** 2).sum(1)
            a, b = e[y[test] == 1], e[y[test] == 0]
            auc = float(((a[:, None] < b).mean() + 0.5 * (a[:, None] == b).mean())) if len(a) and len(b) else 0.5
            loss = float((a.mean() if len(a) else 0) + (np.log1p(np.exp(margin - b)).mean() if len(b) else 0))
            history.append({"round": k, "auc": auc, "loss": loss})
            for t in tell:
                t.fire("on_validation", **history[-1])
            if auc > best[0]:
                best = (auc, w.copy())
                if path:
                    Head(w).save(path)
    for t in tell:
        t.fire("on_training_end", head=Head(best[1]), history=history)
    return Head(best[1]), history


@EMBEDDERS.register("order")
def order_embedding(members: DataFrame, edges: DataFrame, head: Head) -> DataFrame:
    """``nb, anchor, emb`` by a trained head over the structural embedding; a product of small matrices, in Spark's expressions."""
    rows = [F.array(*[F.lit(float(x)) for x in r]) for r in head.weights]
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    base = contain.structural_embedding(members, edges)
    return base.select("nb", "anchor", F.array(*[dot(F.col("emb"), r) for r in rows]).alias("emb"))

"""How well scores find what is marked: confusion, curves, areas, and scores of anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.ranks import running, with_totals


def best_by_anchor(beams: DataFrame) -> DataFrame:
    """``anchor, score``: the largest of each anchor's scores."""
    return beams.groupBy("anchor").agg(F.max("score").alias("score"))


def node_scores(nodes: DataFrame, verified: DataFrame, truth: DataFrame) -> DataFrame:
    """``node, score, y``: nodes without a score have 0, nodes outside ``truth`` (``node``) are normal."""
    s = best_by_anchor(verified).withColumnRenamed("score", "s")
    t = truth.select(F.col("node").alias("t")).distinct()
    out = nodes.join(s, F.col("node") == F.col("anchor"), "left").join(t, F.col("node") == F.col("t"), "left")
    return out.select("node", F.coalesce("s", F.lit(0.0)).alias("score"), F.col("t").isNotNull().cast("int").alias("y"))


def confusion(scored: DataFrame, predicted: str = "pred", truth: str = "y") -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall, f1. Rates without a denominator are null."""
    p, y = F.col(predicted) == 1, F.col(truth) == 1
    c = scored.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _steps(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """``threshold, p, n, tp, fp, all_p, all_n`` for every distinct score: positives and negatives of it, with all of higher scores, and of all."""
    by = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum((1 - F.col(truth)).cast("long")).alias("n"))
    c = running(by, [F.desc("threshold")], F.col("p"), "tp", "curve")
    c = running(c, [F.desc("threshold")], F.col("n"), "fp", "curve")
    c = c.withColumn("tp", F.col("tp") + F.col("p")).withColumn("fp", F.col("fp") + F.col("n"))
    return with_totals(c, all_p=F.sum("p"), all_n=F.sum("n"))


def _rates(steps: DataFrame) -> DataFrame:
    """With ``tpr, fpr``, and those of the step before, ``t0, f0``."""
    rate = lambda a, b: F.try_divide(a.cast("double"), F.col(b).cast("double"))
    tp, fp = F.col("tp"), F.col("fp")
    return steps.select("threshold", "tp", "fp", rate(tp, "all_p").alias("tpr"), rate(fp, "all_n").alias("fpr"), rate(tp - F.col("p"), "all_p").alias("t0"), rate(fp - F.col("n"), "all_n").alias("f0"))


def roc_curve(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """``threshold, tp, fp, tpr, fpr`` for every distinct score, from the highest on.

    Counts are summed by score first, and then over ranges of scores, so no task sees all of them.
    """
    return _rates(_steps(scored, score, truth)).drop("t0", "f0")


def auroc(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """One row: the area under the curve by trapezoids; null if only one class is there."""
    c = _rates(_steps(scored, score, truth))
    return c.agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auroc"))


def average_precision(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """One row: the sum of precision over the steps of recall; null without positives."""
    c = _rates(_steps(scored, score, truth))
    return c.agg(F.sum((F.col("tpr") - F.col("t0")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def youden(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """One row: the score with the largest ``tpr - fpr``, the highest of equal ones, and its mirror ``1 - threshold``."""
    c = roc_curve(scored, score, truth).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = c.filter(F.col("j").isNotNull()).agg(F.max(F.struct(F.round("j", 12).alias("j"), F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.j").alias("youden_j"), (1 - F.col("b.threshold")).alias("optimal_threshold"))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """The column moved to [0, 1]; 0 where all values are equal."""
    d = with_totals(df, _low=F.min(column), _high=F.max(column))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(0.0))
    return d.withColumn(out, scaled).drop("_low", "_high")


def report(nodes: DataFrame, verified: DataFrame, truth: DataFrame) -> DataFrame:
    """One row with all metrics of a search: nodes that are anchors of verified patterns are predicted."""
    s = node_scores(nodes, verified, truth)
    hit = verified.select(F.col("anchor").alias("a")).distinct()
    s = s.join(hit, F.col("node") == F.col("a"), "left").withColumn("pred", F.col("a").isNotNull().cast("int"))
    return confusion(s).join(auroc(s)).join(average_precision(s)).join(youden(s).select("optimal_threshold"), how="left")  # single rows

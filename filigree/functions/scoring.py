"""Scores of patterns as Column expressions; lower is more anomalous.

All take the same columns and ignore those they don't need: frequency, weight (size over all nodes), the last
score, density and frequency gradient.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.registry import SCORERS


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@SCORERS.register("freq")
def freq(f="freq", w="weight", alpha: float = 0.5, **_) -> Column:
    return _c(f)


@SCORERS.register("weighted")
def weighted(f="freq", w="weight", alpha: float = 0.5, **_) -> Column:
    return F.lit(alpha) * _c(f) + F.lit(1 - alpha) * _c(w)


@SCORERS.register("harmonic")
def harmonic(f="freq", w="weight", alpha: float = 0.5, **_) -> Column:
    """Product over sum, half the harmonic mean; 0 if the sum isn't positive."""
    return F.when(_c(f) + _c(w) > 0, _c(f) * _c(w) / (_c(f) + _c(w))).otherwise(F.lit(0.0))


@SCORERS.register("geometric")
def geometric(f="freq", w="weight", alpha: float = 0.5, **_) -> Column:
    return F.sqrt(_c(f) * _c(w))


@SCORERS.register("arithmetic")
def arithmetic(f="freq", w="weight", alpha: float = 0.5, **_) -> Column:
    return (_c(f) + _c(w)) / 2


@SCORERS.register("density_aware")
def density_aware(f="freq", w="weight", alpha: float = 0.5, density="density", **_) -> Column:
    """Frequency over density; the frequency alone where there is hardly an edge."""
    d = _c(density)
    return F.when(d.isNull() | (d < 1e-6), _c(f)).otherwise(_c(f) / d)


@SCORERS.register("freq_gradient")
def freq_gradient(f="freq", w="weight", alpha: float = 0.5, gradient="gradient", **_) -> Column:
    return _c(f) + F.lit(alpha) * F.coalesce(_c(gradient), F.lit(0.0))


@SCORERS.register("structural")
def structural(f="freq", w="weight", alpha: float = 0.5, density="density", gradient="gradient", **_) -> Column:
    dense = _c(f) / F.greatest(F.coalesce(_c(density), F.lit(1.0)), F.lit(0.01))
    return F.lit(alpha) * dense + F.lit(1 - alpha) * (_c(f) + F.lit(0.5) * F.coalesce(_c(gradient), F.lit(0.0)))


@SCORERS.register("freq_verif")
def freq_verif(f="freq", w="weight", alpha: float = 0.5, last_score="last_score", **_) -> Column:
    return _c(f) + _c(w) * (_c(f) - _c(last_score))


def history_gradient(history: str | Column) -> Column:
    """Mean slope of an array of (size, freq): the sum of the slopes between neighbours whose size grows, over their number; 0 below two."""
    h = _c(history)
    n = F.size(h)
    steps = F.zip_with(
        F.slice(h, 2, F.greatest(n - 1, F.lit(0))),
        F.slice(h, 1, F.greatest(n - 1, F.lit(0))),
        lambda b, a: F.when(b["size"] > a["size"], (b["freq"] - a["freq"]) / (b["size"] - a["size"])).otherwise(F.lit(0.0)),
    )
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (n - 1))


def unchanged(score: str | Column, last: str | Column, count: str | Column, downwards: bool = False) -> Column:
    """Steps without a better score: one more if the score did not fall (or, ``downwards``, did not rise), else 0."""
    still = _c(score) <= _c(last) if downwards else _c(score) >= _c(last)
    return F.when(still, _c(count) + 1).otherwise(F.lit(0))


def max_strength(scorer: str, max_freq: float, max_steps: int, num_nodes: int, alpha: float = 0.5) -> Column:
    """The score under which a pattern counts as rare."""
    some = dict(density=F.lit(None).cast("double"), gradient=F.lit(0.0), last_score=F.lit(0.0))
    return SCORERS[scorer](F.lit(max_freq / num_nodes), F.lit(max_steps / num_nodes), alpha=alpha, **some)

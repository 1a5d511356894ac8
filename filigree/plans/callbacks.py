"""What a run tells while it goes on. A callback that fails doesn't stop the run."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from filigree.registry import CALLBACKS
from filigree.sources.files import write_json

log = logging.getLogger("filigree")

HOOKS = ("on_run_start", "on_run_end", "on_step_end", "on_search_start", "on_search_end", "on_training_start", "on_training_step", "on_validation", "on_training_end", "on_metrics")


class Callback:
    """Methods named like ``HOOKS`` are called with keywords."""

    def fire(self, hook: str, **what) -> None:
        if hook not in HOOKS:
            raise ValueError(f"unknown hook {hook!r}")
        f = getattr(self, hook, None)
        if f is None:
            return
        try:
            f(**what)
        except Exception:
            log.exception("%s failed in %s", type(self).__name__, hook)


class Several(Callback):
    def __init__(self, parts: list[Callback]):
        self.parts = parts

    def fire(self, hook: str, **what) -> None:
        for p in self.parts:
            p.fire(hook, **what)


@CALLBACKS.register("logging")
class Logging(Callback):
    def on_step_end(self, step: int, beams: DataFrame, **_) -> None:
        b = beams.selectExpr("count(*) n", "min(freq) low", "percentile(freq, 0.5) mid", "max(freq) high").head()
        log.info("step %s: %s beams, frequency %s to %s, median %s", step, b["n"], b["low"], b["high"], b["mid"])

    def on_search_end(self, beams: DataFrame, **_) -> None:
        log.info("%s patterns", beams.count())


@CALLBACKS.register("evaluation")
class Evaluation(Callback):
    """Writes metrics as JSON."""

    def __init__(self, path: str = "metrics"):
        self.path = path

    def on_metrics(self, metrics: DataFrame, **_) -> None:
        write_json(metrics, self.path)


@CALLBACKS.register("checkpoint")
class Checkpoint(Callback):
    """Saves a head in training at intervals."""

    def __init__(self, path: str = "head.npz", every: int = 50):
        self.path, self.every, self.started = path, every, False

    def on_training_start(self, **_) -> None:
        self.started = True

    def on_training_step(self, round: int, head, **_) -> None:
        if self.started and round % self.every == 0:
            head.save(self.path)


@CALLBACKS.register("visualization")
class Export(Callback):
    """Rows that a plotting tool can draw: members and edges of the patterns, as Parquet."""

    def __init__(self, path: str = "patterns"):
        self.path = path

    def on_search_end(self, beams: DataFrame, **_) -> None:
        beams.select("start", "neigh", "freq", "score").write.mode("overwrite").parquet(self.path)

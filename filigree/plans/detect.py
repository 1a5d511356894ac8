"""A detection from source to metrics: load, sample, embed, choose starts, search, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.config import Config
from filigree.functions import scoring
from filigree.operators import contain, graph, metrics, outliers, patterns, sampling, search, train
from filigree.plans.callbacks import CALLBACKS, Several
from filigree.registry import EMBEDDERS, SAMPLERS, SEARCHES
from filigree.session import materialise
from filigree.sources import files, graphs


def load(spark: SparkSession, config: Config) -> graphs.Graph:
    d = config.dataset
    options = {"relation": d.relation} if d.relation else {}
    nodes, edges = graphs.load(spark, d.name, d.path, **options)
    if d.injection:
        edges, marks = graph.inject(nodes, edges, d.injection, d.n_groups, d.group_size, config.seed)
        nodes = marks
    return materialise(nodes, "nodes"), materialise(edges, "edges")


def sample(nodes: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    s = config.sampling
    if s.sampler.startswith("radial"):
        return SAMPLERS.build(s.sampler, nodes.select("node"), edges, radius=s.radius, subsample_size=s.subsample_size, seed=config.seed)
    return SAMPLERS.build(s.sampler, nodes.select("node"), edges, n_neighborhoods=s.n_neighborhoods, min_size=s.min_size, max_size=s.max_size, seed=config.seed)


def embed(members: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    """``nb, anchor, emb, size``."""
    options = {"head": train.Head.load(config.model.checkpoint)} if config.model.checkpoint else {}
    e = EMBEDDERS.build(config.model.embedder, members, edges, **options)
    return e.join(members.groupBy(F.col("nb").alias("s_nb")).agg(F.count("*").alias("size")), F.col("nb") == F.col("s_nb")).drop("s_nb")


def starts(embs: DataFrame, config: Config, num_nodes: int) -> DataFrame:
    """``anchor`` of the nodes that the detectors choose; frequencies are measured against references, limits against nodes."""
    o = config.outlier
    options = {
        "model_based": {"freq_thresh": o.max_freq / num_nodes, "tau": config.model.tau},
        "isolation_forest": {"max_neigh_len": config.search.max_steps, "contamination": o.contamination, "seed": config.seed},
    }
    return outliers.detect(embs, [(m, options[m]) for m in o.methods], o.combine)


def run(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """``nodes, edges, embs, starts, verified, patterns, metrics``, all written out before the next step reads them."""
    tell = Several([CALLBACKS.build(c) for c in config.callbacks])
    tell.fire("on_run_start", config=config)
    nodes, edges = load(spark, config)
    n = nodes.count()
    members = materialise(sample(nodes, edges, config), "members")
    embs = files.kept(spark, "embeddings", config, lambda: embed(members, edges, config), of=config.dataset.path)
    s = config.search
    limit = s.max_freq
    if s.calibrate:
        freqs = contain.frequencies(embs, embs, config.model.tau, query_id="nb", ref_id="nb")
        limit = contain.calibrate(freqs, s.max_steps).head()["max_freq"] * n
    begin = materialise(starts(embs, config, n).select(F.col("anchor").alias("node")), "starts")
    strength = float(spark.range(1).select(scoring.max_strength(s.scoring_function, limit, s.max_steps, n, s.alpha).cast("double").alias("x")).head()["x"])
    options = dict(
        scorer=s.scoring_function, n_beams=s.n_beams, min_strength=s.min_strength, max_strength=strength, alpha=s.alpha, max_unchanged=s.max_unchanged, min_steps=s.min_steps, max_steps=s.max_steps,
        max_cands=s.max_cands, sample_random_cands=s.sample_random_cands, add_verified_neighs=s.add_verified_neighs, min_neigh_repeat=s.min_neigh_repeat, min_subgraph_size=s.min_subgraph_size,
        tau=config.model.tau, seed=config.seed, callbacks=[tell],
    )
    if s.strategy == "sampled":
        options["sample_size"] = s.sample_size
    found = SEARCHES.build(s.strategy, begin, edges, embs.select("nb", "emb"), num_nodes=n, **options)
    anchored = found.select(F.col("beam").alias("nb"), F.col("neigh")[0].alias("anchor"), F.explode("neigh").alias("node"))
    hashes = patterns.wl_hash(anchored, edges, s.max_steps + 1)
    stored = hashes.join(found.select(F.col("beam").alias("b"), F.col("neigh")[0].alias("anchor")), F.col("nb") == F.col("b")).drop("b")
    truth = nodes.filter(graphs.anomaly_label(config.dataset.task) == 1).select("node")
    result = materialise(metrics.report(nodes, found.select(F.col("neigh")[0].alias("anchor"), (1 - F.col("score")).alias("score")), truth), "metrics")
    tell.fire("on_metrics", metrics=result)
    if config.output:
        search.as_json(found, truth).write.mode("overwrite").text(f"{config.output}/anomalies")
        files.write_json(result, f"{config.output}/metrics")
    tell.fire("on_run_end", verified=found)
    return {"nodes": nodes, "edges": edges, "embs": embs, "starts": begin, "verified": found, "patterns": stored, "metrics": result}


def calibrate_only(spark: SparkSession, config: Config) -> DataFrame:
    nodes, edges = load(spark, config)
    embs = embed(materialise(sample(nodes, edges, config), "members"), edges, config)
    return contain.calibrate(contain.frequencies(embs, embs, config.model.tau, query_id="nb", ref_id="nb"), config.search.max_steps)


def train_only(spark: SparkSession, config: Config) -> tuple[train.Head, list[dict]]:
    t = config.training
    return train.train(spark, t.n_pairs, rounds=t.rounds, margin=config.model.margin, lr=t.lr, eval_interval=t.eval_interval, path=config.model.checkpoint, seed=config.seed, hard_ratio=t.hard_neg_ratio, callbacks=config.callbacks)


__all__ = ["calibrate_only", "embed", "load", "run", "sample", "sampling", "starts", "train_only"]

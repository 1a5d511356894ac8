"""Search for rare patterns: beams that grow a node at a time, for all starting nodes at once.

A beam is a row: ``start, beam, neigh`` (ordered, the anchor first), ``size, freq, weight, score, last_score,
unchange, original, history`` (sizes and frequencies). What the frontier is follows from ``neigh``. Choices that the
order of a loop could make (votes within a step, equal scores) are made by ids, so a run comes out the same again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.functions import scoring
from filigree.operators import contain, graph, sampling
from filigree.registry import CALLBACKS, SCORERS, SEARCHES
from filigree.session import materialise, remove

BEAM = "start long, beam string, neigh array<long>, size int, freq double, weight double, score double, last_score double, unchange int, original boolean, density double, gradient double, history array<struct<size:int,freq:double>>"


@dataclass
class SearchConfig:
    """Of a search. ``tau``: violation under which a pattern counts as contained."""

    scorer: str = "freq"
    n_beams: int = 1
    min_strength: float = 0.0
    max_strength: float = 0.01
    alpha: float = 0.33
    max_unchanged: int = 5
    unchange_direction: bool = False
    min_steps: int = 1
    max_steps: int = 7
    max_cands: int | None = None
    sample_random_cands: float | None = None
    add_verified_neighs: bool = False
    min_neigh_repeat: int = 2
    sample_size: int | None = None
    min_subgraph_size: int = 1
    freq_drop_weight: float = 0.0
    use_votes: bool = True
    keep_early: bool = True
    tau: float = 1e-9
    seed: int = 42
    callbacks: list = field(default_factory=list)


def beam_id(neigh: str = "neigh"):
    return F.concat_ws(",", F.transform(F.col(neigh), lambda x: x.cast("string")))


def members_of(beams: DataFrame) -> DataFrame:
    """``nb, anchor, node`` of beams named by ``beam``."""
    return beams.select(F.col("beam").alias("nb"), F.col("neigh")[0].alias("anchor"), F.explode("neigh").alias("node"))


def candidates(beams: DataFrame, edges: DataFrame, ratio: float | None = None, most: int | None = None, seed: int = 42, near: bool = False) -> DataFrame:
    """``beam, node`` (and ``near``, all members that it has an edge to): neighbours of a beam's members that are no members, down-sampled by hash. Beams without any drop out."""
    members = beams.select("beam", "neigh", F.explode("neigh").alias("at")).join(edges, F.col("at") == F.col("src"))
    links = members.filter(~F.array_contains("neigh", F.col("dst"))).select("beam", "at", F.col("dst").alias("node"))
    if ratio is None and most is not None:
        # What is not among the first of a member's neighbours is not among those of the beam, so the others needn't move.
        links = sampling.down_sample(links, ["beam", "at"], "node", None, most, seed, ["beam"])
    # A node among the first of the beam is so for every member that it is next to, so all its links are there.
    new = links.groupBy("beam", "node").agg(F.collect_set("at").alias("near")) if near else links.select("beam", "node").distinct()
    return sampling.down_sample(new, ["beam"], "node", ratio, most, seed)


def grown(beams: DataFrame, cands: DataFrame) -> DataFrame:
    """Beams with each of their candidates added; the old score is the last one now. ``links`` grow with them where candidates have ``near``."""
    near = "near" in cands.columns
    c = cands.select(F.col("beam").alias("c_beam"), F.col("node").alias("added"), *(["near"] if near else []))
    g = beams.join(c, F.col("beam") == F.col("c_beam")).drop("c_beam")
    if near:
        more = F.transform("near", lambda x: F.struct(x.cast("long").alias("src"), F.col("added").cast("long").alias("dst")))
        g = g.withColumn("links", F.concat("links", more)).drop("near")
    neigh = F.concat("neigh", F.array("added"))
    return g.withColumn("last_score", F.col("score")).withColumn("neigh", neigh).withColumn("beam", F.concat_ws(",", F.col("beam"), F.col("added").cast("string"))).withColumn("size", F.size("neigh")).drop("added")


def scored(beams: DataFrame, edges: DataFrame, refs: DataFrame, config: SearchConfig, num_nodes: int, known: bool = False, n_refs: int | None = None, used: list | None = None) -> DataFrame:
    """Beams with frequency, weight, score and what the score needs, measured against ``refs`` (``nb, emb`` and, if ``known``, ``freq``).

    Embedding and density come from the same counts, so the induced subgraphs are joined once; beams with ``links`` bring theirs and
    need no join with the edges.
    ``used`` gets the tables that can go when the result has been written.
    """
    beams = materialise(beams, "search-grown")
    n_refs = refs.count() if n_refs is None else n_refs
    linked = "links" in beams.columns
    if linked:
        both = F.explode(F.concat("links", F.transform("links", lambda x: F.struct(x["dst"].alias("src"), x["src"].alias("dst")))))
        inner = beams.select(F.col("beam").alias("nb"), both.alias("e")).select("nb", "e.src", "e.dst")
    else:
        inner = materialise(graph.induced_small(edges, beams.select(F.col("beam").alias("nb"), "neigh")), "search-inner")
    counts = contain.structural_counts(members_of(beams), edges, inner)
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    density = F.when(F.col("n_nodes") < 2, 0.0).otherwise(F.col("n_edges") / pairs).cast("double")
    shape = materialise(counts.select(F.col("nb").alias("q_beam"), F.xxhash64("nb").alias("qid"), contain.as_embedding().alias("emb"), density.alias("new_density")), "search-shape")
    hits = contain.containment_counts(shape, refs, config.tau, query_id="qid", ref_id="nb", ref_freq="freq" if known else None)
    if used is not None:
        used += [beams, inner, shape]
    if known:
        freqs = contain.lower_bounded(hits, n_refs, config.max_strength)
    else:
        freqs = hits.select("qid", (F.col("n_contained") / F.lit(float(max(1, n_refs)))).alias("freq"))
    freqs = shape.select("qid", "q_beam", "new_density").join(freqs.select("qid", F.col("freq").alias("new_freq")), "qid").drop("qid")
    b = beams.join(freqs, F.col("beam") == F.col("q_beam")).drop("q_beam")
    b = b.withColumn("freq", F.col("new_freq")).withColumn("density", F.col("new_density")).drop("new_freq", "new_density")
    b = b.withColumn("weight", F.col("size") / F.lit(float(num_nodes)))
    b = b.withColumn("history", F.concat("history", F.array(F.struct(F.col("size").alias("size"), F.col("freq").alias("freq")))))
    b = b.withColumn("gradient", scoring.history_gradient("history"))
    last = F.coalesce("last_score", F.lit(float("inf")))
    b = b.withColumn("score", SCORERS[config.scorer](alpha=config.alpha, last_score=last))
    return b.withColumn("unchange", scoring.unchanged(F.col("score"), last, F.col("unchange"), config.unchange_direction)).select(*_fields(), *(["links"] if linked else []))


def _fields() -> list[str]:
    return ["start", "beam", "neigh", "size", "freq", "weight", "score", "last_score", "unchange", "original", "density", "gradient", "history"]


def prune(beams: DataFrame, low: float, high: float, max_unchanged: int) -> DataFrame:
    """Without those that are too frequent and have been for too long, and those under ``low``; beams without a score stay."""
    gone = ((F.col("score") > high) & (F.col("unchange") > max_unchanged)) | (F.col("score") < low)
    return beams.filter(~F.coalesce(gone, F.lit(False)))


def verified(beams: DataFrame, low: float, high: float) -> DataFrame:
    return beams.filter(F.col("score").between(low, high))


def remaining(beams: DataFrame, low: float, high: float) -> DataFrame:
    return beams.filter(~F.coalesce(F.col("score").between(low, high), F.lit(False)))


def keep_tied(beams: DataFrame, votes: DataFrame | None, k: int) -> DataFrame:
    """Of each start the beams that tie with its least score, at most ``k``: those whose last node has most votes, then the smaller id."""
    best = F.rank().over(Window.partitionBy("start").orderBy(F.col("score").asc_nulls_last()))
    tied = beams.withColumn("_b", best).filter(F.col("_b") == 1).drop("_b").withColumn("_node", F.element_at("neigh", -1))
    if votes is not None:
        v = votes.select(F.col("node").alias("v_node"), F.col("votes").alias("_votes"))
        tied = tied.join(v, F.col("_node") == F.col("v_node"), "left").drop("v_node").withColumn("_votes", F.coalesce("_votes", F.lit(0)))
    else:
        tied = tied.withColumn("_votes", F.lit(0))
    order = Window.partitionBy("start").orderBy(F.desc("_votes"), "_node", "beam")
    return tied.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r", "_votes", "_node")


def keep_top(beams: DataFrame, k: int, drop_weight: float = 0.0) -> DataFrame:
    """Of each start the ``k`` least scores; a fall of the frequency since the step before counts in favour, ``drop_weight`` times."""
    previous = F.when(F.size("history") > 1, F.element_at(F.col("history"), -2)["freq"])
    fall = F.greatest(F.lit(0.0), F.coalesce(previous - F.col("freq"), F.lit(0.0)))
    key = F.col("score") - F.lit(drop_weight) * fall
    order = Window.partitionBy("start").orderBy(key.asc_nulls_last(), F.element_at("neigh", -1), "beam")
    return beams.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def count_votes(beams: DataFrame) -> DataFrame:
    """``node, votes``: how many beams added each node last."""
    return beams.groupBy(F.element_at("neigh", -1).alias("node")).agg(F.count("*").alias("votes"))


def neighbour_copies(beams: DataFrame) -> DataFrame:
    """For every member but the anchor a beam anchored there, with the rest of the members and the same score."""
    other = beams.withColumn("new_anchor", F.explode(F.slice("neigh", 2, F.greatest(F.size("neigh") - 1, F.lit(0)))))
    rest = F.filter(F.col("neigh"), lambda x: x != F.col("new_anchor"))
    neigh = F.concat(F.array("new_anchor"), rest)
    return other.withColumn("neigh", neigh).withColumn("beam", beam_id()).withColumn("start", F.col("new_anchor")).withColumn("original", F.lit(False)).drop("new_anchor")


def promoted(copies: DataFrame, least: int) -> DataFrame:
    """``anchor, n``: nodes that more than ``least`` copies are anchored at."""
    return copies.groupBy(F.col("neigh")[0].alias("anchor")).agg(F.count("*").alias("n")).filter(F.col("n") > least)


def first_by_anchor(beams: DataFrame) -> DataFrame:
    """One verified beam an anchor: the smallest, then that with the least score."""
    order = Window.partitionBy(F.col("neigh")[0]).orderBy("size", "score", "beam")
    return beams.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).drop("_r")


def initial(starts: DataFrame, edges: DataFrame, config: SearchConfig) -> DataFrame:
    """A beam of one node for each start, or of ``min_subgraph_size`` nodes grown at random without scores."""
    s = starts.select(F.col("node").alias("start"))
    if config.min_subgraph_size > 1:
        seeds = s.select(F.col("start").alias("nb"), F.col("start").alias("anchor"), F.lit(config.min_subgraph_size).alias("size"))
        made = sampling.grow(seeds, edges, "size", config.min_subgraph_size, config.seed)
        s = made.groupBy(F.col("nb").alias("start")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]).alias("neigh"))
    else:
        s = s.withColumn("neigh", F.array("start"))
    none = lambda kind: F.lit(None).cast(kind)
    return s.select(
        F.col("start").cast("long"), beam_id().alias("beam"), F.col("neigh").cast("array<long>"), F.size("neigh").alias("size"), none("double").alias("freq"), none("double").alias("weight"),
        none("double").alias("score"), none("double").alias("last_score"), F.lit(0).alias("unchange"), F.lit(True).alias("original"), none("double").alias("density"),
        F.lit(0.0).alias("gradient"), none("array<struct<size:int,freq:double>>").alias("h"),
    ).withColumn("history", F.coalesce("h", F.array().cast("array<struct<size:int,freq:double>>"))).drop("h")


def with_links(beams: DataFrame, edges: DataFrame) -> DataFrame:
    """Beams with ``links``, the edges among their members, each once."""
    kind = "array<struct<src:bigint,dst:bigint>>"
    inner = graph.induced_small(edges, beams.filter(F.size("neigh") > 1).select(F.col("beam").alias("nb"), "neigh")).filter(F.col("src") < F.col("dst"))
    links = inner.distinct().groupBy(F.col("nb").alias("l_beam")).agg(F.collect_list(F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))).alias("links"))
    return beams.join(links, F.col("beam") == F.col("l_beam"), "left").drop("l_beam").withColumn("links", F.coalesce("links", F.array().cast(kind)))


def run(starts: DataFrame, edges: DataFrame, refs: DataFrame, config: SearchConfig, num_nodes: int, known: bool = False, clean: bool = False) -> DataFrame:
    """Verified beams, one an anchor (``BEAM``): at most ``max_steps`` rounds, each written out, so lineage stays short.

    ``keep_early``: a beam verified before ``min_steps`` is kept as it is, else it is dropped. ``clean``: edges are written out, each
    once and without loops, and are read as they are.
    """
    spark: SparkSession = edges.sparkSession
    e = edges.select("src", "dst") if clean else materialise(graph.drop_loops(edges).select("src", "dst").distinct(), "search-edges")
    if config.sample_size:
        refs = sampling.hash_sample(refs, "nb", config.sample_size, config.seed, "refs")
    refs = materialise(refs, "search-refs")
    n_refs = refs.count()
    beams = initial(starts, e, config)
    # A step adds the edges of the node that it adds, which its candidates were found by.
    none = F.array().cast("array<struct<src:bigint,dst:bigint>>")
    beams = materialise(with_links(beams, e) if config.min_subgraph_size > 1 else beams.withColumn("links", none), "search-beams")
    done = spark.createDataFrame([], BEAM)
    votes: DataFrame | None = None
    tell = [CALLBACKS.build(c) if isinstance(c, str) else c for c in config.callbacks]
    for t in tell:
        t.fire("on_search_start", starts=beams.drop("links"), config=config)
    made = [refs, beams] if clean else [e, refs, beams]
    for step in range(max(1, config.min_subgraph_size), config.max_steps):
        c = candidates(beams, e, config.sample_random_cands, config.max_cands, config.seed + step, True)
        used: list[DataFrame] = []
        step_scores = materialise(scored(grown(beams, c), e, refs, config, num_nodes, known, n_refs, used), "search-scored")
        now = prune(step_scores, config.min_strength, config.max_strength, config.max_unchanged)
        kept = keep_tied(now, votes, config.n_beams) if config.use_votes else keep_top(now, config.n_beams, config.freq_drop_weight)
        kept = materialise(kept, "search-kept")
        remove(step_scores, *used)
        made.append(kept)
        new = verified(kept, config.min_strength, config.max_strength).drop("links")
        if step + 1 >= config.min_steps or config.keep_early:
            done = done.unionByName(new)
            if config.add_verified_neighs:
                copies = neighbour_copies(new)
                some = promoted(copies, config.min_neigh_repeat).select(F.col("anchor").alias("p"))
                done = done.unionByName(copies.join(some, F.col("start") == F.col("p"), "left_semi"))
        beams = remaining(kept, config.min_strength, config.max_strength)
        if config.use_votes:
            more = count_votes(kept)
            votes = more if votes is None else votes.unionByName(more).groupBy("node").agg(F.sum("votes").alias("votes"))
        for t in tell:
            t.fire("on_step_end", step=step, beams=kept.drop("links"))
        if beams.isEmpty():
            break
    out = materialise(first_by_anchor(done), "search-verified")
    remove(*made)
    for t in tell:
        t.fire("on_search_end", beams=out)
    return out


@SEARCHES.register("strength")
def strength(starts, edges, refs, num_nodes: int, **options) -> DataFrame:
    """Against all references; what is verified before ``min_steps`` is dropped."""
    return run(starts, edges, refs, SearchConfig(**{"keep_early": False} | options), num_nodes)


@SEARCHES.register("sampled")
def sampled(starts, edges, refs, num_nodes: int, sample_size: int = 500, **options) -> DataFrame:
    """Against ``sample_size`` references, with the frequencies known of these as lower bounds where they have a ``freq``."""
    return run(starts, edges, refs, SearchConfig(**options, sample_size=sample_size), num_nodes, known="freq" in refs.columns)


def as_json(beams: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """``json``: one document a beam; an infinite last score is null."""
    frontier = beams
    if truth is not None:
        t = truth.select(F.col("node").alias("t")).distinct()
        frontier = frontier.join(t, F.col("neigh")[0] == F.col("t"), "left").withColumn("is_true", F.col("t").isNotNull()).drop("t")
    last = F.when(F.col("last_score") < float("inf"), F.col("last_score"))
    cols = [F.col("neigh")[0].alias("anchor"), F.element_at("neigh", -1).alias("added_node"), "neigh", F.size("neigh").alias("neigh_len"), "weight", "freq", "score", last.alias("last_score"), "unchange", "original", F.col("history").alias("freq_history")]
    return frontier.select(F.to_json(F.struct(*cols, *(["is_true"] if truth is not None else []))).alias("json"))

"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source_size`` copies. Prefix sums of that number
over the source's documents, ordered by size, start at one random offset; a document is emitted once
for each integer boundary that its stretch crosses. Ordering by size makes the sample stratified, so
the words taken differ from the target by less than about the source's largest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import WORD, materialise, rank_within, through


#: Neighbours whose places are turned together.
RUN = 16


def word_count(text: str) -> Column:
    """Words without a Python pass: the separators that start a word."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """Targets of each source, one row a source: ``source, source_size, target``.

    ``sizes`` has one row a source. Sources by code point, null last, weigh ``weights`` in turn and share the
    whole size; targets stop at ``cap`` times the source's size and the rest is shared again by weight
    until none is above. Sources are sorted by cap over weight, so that the fill is one window pass:
    the first ones of that order are full, and all others stand at the same level. Sources that tie in that ratio come by
    code point. One without words has target 0, and so have all if none has words; no rows give none.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    d = d.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    d = d.withColumn("ratio", F.col("most") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source")
    d = d.withColumn("full_before", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("w_from", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # The level at which this source and all later ones would stand. It rises while it fills sources and falls after that, so the highest is right.
    d = d.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("w_from"))
    d = d.withColumn("level", F.max("level").over(everything))
    return d.select("source", "source_size", F.least(F.col("most"), F.col("w") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[float] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    seed: int = 20,
    tries: int = 64,
    mark: bool = False,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of each document (+ the ``mark`` of its row).

    Null texts have size 0; documents without words get 0 copies, and so do sources without words.
    Null sources are a source. Null ids and repeated rows are documents like others; rows that tie in
    size, id and hash get neighbouring ranks, so their copies differ by one at most.
    The order is by size, then by a seeded hash of the id; each run of ``RUN`` neighbours (the last may be shorter) is
    turned by a number of places. Of ``tries`` pairs of a random offset and a turn, a source takes the one whose taken words
    come nearest to its target: offsets are one random number and its ``tries`` even steps around the circle. Whatever the
    pair, places are 0 to n - 1, so copies are those of the source's own prefix sums. All of it depends on the rows alone, so reruns agree.
    Ranks are made over all tasks by ranges (`rank_within`): no source meets in one task. No rows give none.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("tie"),
        *([mark_of(docs).alias("mark")] if mark else []),
    )
    base = materialise(base, "mix-sizes")  # texts are read once, the ranges are sampled and dealt from numbers
    ranked = rank_within(base, "source", ["size", "tie", "doc_id"], "rank", "mix-rank")
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    targets = source_targets(sizes.select("source", "source_size"), list(weights), cap).withColumn("start", start)
    targets = targets.join(sizes.select(F.col("source").alias("n_source"), "n"), F.col("source").eqNullSafe(F.col("n_source"))).drop("n_source")
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = materialise(targets.withColumnRenamed("source", "t_source"), "mix-targets")

    same = F.col("source").eqNullSafe(F.col("t_source"))
    placed = ranked.select(F.col("source").cast("string").alias("source"), "size", "rank").join(targets.select("t_source", "n", "rate", "start"), same)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that each pair takes of the batch's documents, by source."""
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            of, names = np.asarray(names.indices), names.dictionary
            size, rank, n, rate, start = (np.asarray(batch.column(i)) for i in range(1, 6))
            first = rank - rank % RUN
            for j in range(tries):
                at = first + (rank - first + j % RUN) % np.minimum(RUN, n - first)
                offset = np.fmod(start + j / tries, 1.0)
                words = (np.floor((at + 1) * rate + offset) - np.floor(at * rate + offset)) * size
                yield pa.RecordBatch.from_arrays([names, pa.array([j] * len(names), pa.int32()), pa.array(np.bincount(of, words, len(names)).astype(np.int64))], names=["w_source", "j", "words"])

    words = through(placed.select("source", "size", "rank", "n", "rate", "start"), "w_source string, j int, words long", totals)
    words = words.groupBy("w_source", "j").agg(F.sum("words").alias("words")).join(targets.select("t_source", "target", "start"), F.col("w_source").eqNullSafe(F.col("t_source")))
    offset = F.pmod(F.col("start") + F.col("j") / F.lit(float(tries)), F.lit(1.0))
    best = words.groupBy("w_source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), offset.alias("offset"), (F.col("j") % RUN).alias("turn"))).alias("best"))
    chosen = best.select(F.col("w_source").alias("c_source"), F.col("best.offset").alias("offset"), F.col("best.turn").cast("long").alias("turn"))
    plan = targets.join(chosen, F.col("t_source").eqNullSafe(F.col("c_source"))).drop("c_source")
    first = F.col("rank") - F.col("rank") % RUN
    at = first + (F.col("rank") - first + F.col("turn")) % F.least(F.lit(RUN), F.col("n") - first)
    crossed = F.floor((at + 1) * F.col("rate") + F.col("offset")) - F.floor(at * F.col("rate") + F.col("offset"))
    out = ranked.join(materialise(plan, "mix-plan"), same).withColumn("copies", F.when(F.col("size") > 0, crossed).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["mark"] if mark else []))


def mark_of(docs: DataFrame) -> Column:
    """A hash of a whole row, nulls and where they stand included."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as the mix takes it.

    Null and empty texts, having no words, are not taken; null ids are. Copies come back to their rows by id and ``mark``; equal rows are one, which is emitted as often as all of them together.
    """
    taken = mix(docs, id_col=id_col, mark=True, **options).filter(F.col("copies") > 0)
    taken = taken.groupBy(F.col("doc_id").alias("t_id"), F.col("mark").alias("t_mark")).agg(F.sum("copies").alias("copies"))
    rows = docs.select(F.col(id_col).alias("i"), mark_of(docs).alias("m"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(taken, F.col("i").eqNullSafe(F.col("t_id")) & (F.col("m") == F.col("t_mark"))).dropDuplicates(["i", "m"])
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")

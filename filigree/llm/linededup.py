"""Repeated runs of lines, found by winnowing over line hashes.

A document is the sequence of hashes of its lines that hold words. A window is the shortest run from a line
on that has ``least`` words or more, or the shortest such run up to a line, so every run of that many words is a
union of windows. Of each window the least hash is selected (the leftmost of equal ones), and only selected
places are kept: two documents that share a run share its windows, and with them what is selected, so
no shared run is missed. Places are joined by their hashes; those whose hash stands nowhere else go.
From each place left the match is extended both ways: the windows that selected it reach from it to
the left and to the right, and a window with the same lines as an earlier one is part of a later run. Windows
are told apart by digests of their lines, so no text travels to another, and a place in a run that thousands
share costs as much as one in a run of two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filigree.llm.common import materialise, rows_of, through, utf8

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = "array<struct<fp:long,at:int,reach:array<struct<content:binary,first:int,last:int>>>>"


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) - (1 << 63)


def seeds(text: bytes, least: int) -> list[tuple[int, int, list[tuple[bytes, int, int]]]]:
    """Hash and line of each selected place of a text, and the windows that selected it: digest, first and last line. Lines are counted from 0."""
    lines = [(i, s, len(s.split())) for i, line in enumerate(text.split(b"\n")) if (s := line.strip())]
    if not lines:
        return []
    hashes = [_hash(s) for _, s, _ in lines]
    words = np.array([n for _, _, n in lines], np.int64)
    upto = np.concatenate([[0], np.cumsum(words)])
    # From each line on: the first end with enough words. Up to each line: the last start with enough.
    ends = np.searchsorted(upto, upto[:-1] + least)
    starts = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    spans = {(s, int(e) - 1) for s, e in enumerate(ends) if e < len(upto)} | {(int(s), e) for e, s in enumerate(starts) if s >= 0}
    packed = np.array(hashes, np.int64).tobytes()
    found: dict[int, list] = {}
    for s, e in sorted(spans):
        at = s if s == e else min(range(s, e + 1), key=hashes.__getitem__)
        found.setdefault(at, []).append((hashlib.blake2b(packed[8 * s : 8 * e + 8], digest_size=16).digest(), lines[s][0], lines[e][0]))
    return [(hashes[at], lines[at][0], reach) for at, reach in found.items()]


def repeated_runs(docs: DataFrame, least: int, place: Column, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, runs``: for each document with lines to delete, the spans of lines (first, last) that stand earlier."""
    d = docs.select(place.alias("id"), F.xxhash64(text_col).alias("mark"), utf8(text_col).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = pa.struct([("content", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])
        kind = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("reach", pa.list_(window))]))
        for batch in rows_of(batches):
            found = [
                [{"fp": fp, "at": at, "reach": [{"content": c, "first": s, "last": e} for c, s, e in reach]} for fp, at, reach in seeds(b.as_py(), least)]
                for b in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["id", "mark", "w"])

    every = through(d, f"id long, mark long, w {SEED}", run).select("id", "mark", F.explode("w").alias("w")).select("id", "mark", "w.*")
    every = materialise(every, "lines-seeds")
    # Summed where the places are before they move, so that a frequent hash is one row a task.
    stands = F.struct("id", "mark", "at")
    shared = every.groupBy(F.col("fp").alias("s_fp")).agg(F.min(stands).alias("low"), F.max(stands).alias("high")).filter(F.col("low") < F.col("high")).select("s_fp")
    # Written, so that both sides of the join are plain tables, which Spark can split at a frequent hash; the same below.
    # Both tables grow with the documents, so neither is broadcast at any size.
    shared = materialise(shared, "lines-shared").hint("merge")
    near = every.join(shared, F.col("fp") == F.col("s_fp"), "left_semi").select("id", "mark", F.explode("reach").alias("w")).select("id", "mark", "w.*")
    near = materialise(near, "lines-windows")
    here = F.struct("id", "first")
    origin = near.groupBy(F.col("content").alias("o_content")).agg(F.min(here).alias("origin"), F.max(here).alias("latest")).filter(F.col("origin") < F.col("latest")).drop("latest")
    origin = materialise(origin, "lines-origins").hint("merge")
    later = near.join(origin, F.col("content") == F.col("o_content")).filter(here > F.col("origin"))
    return later.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, n_runs, kept`` (+ the whole ``row`` if ``carry``): texts without later repeated runs.

    A line goes if it lies in a run of ``least`` words or more, whole lines one after another, that also stands
    earlier: in a document with a smaller id, or further up in its own. All is judged on the texts as they came.
    Lines are compared without the white space around them; lines without words count for nothing, and go
    only from within a run. Null texts stay null, and null ids come last. Rows that share an id are one
    place: the same run at the same line of two of them is not later than itself. A run that overlaps its own
    earlier place (a line repeated on and on) goes from its second time on.
    """
    place = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    found = repeated_runs(docs, least, place, id_col, text_col).select(F.col("id").alias("r_id"), F.col("mark").alias("r_mark"), "runs")
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        place.alias("place"),
        F.xxhash64(text_col).alias("mark"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    d = d.join(found, (F.col("place") == F.col("r_id")) & (F.col("mark") == F.col("r_mark")), "left").drop("place", "mark", "r_id", "r_mark")
    d = d.select("doc_id", "text", "runs", *(["row"] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = []
            for text, runs in zip(*batch.columns[1:3], strict=True):
                lines, gone, merged = (text.as_py() or "").split("\n"), set(), 0
                end = -2
                for r in sorted((x["first"], x["last"]) for x in runs.as_py() or ()):
                    merged += r[0] > end + 1
                    gone.update(range(max(r[0], end + 1), r[1] + 1))
                    end = max(end, r[1])
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text.as_py()
                out.append((kept, len(lines), len(gone), merged, kept is not None and (not gone or bool(kept.encode().strip()))))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], names=["doc_id", "text", "n_lines", "n_removed", "n_runs", "kept", *(["row"] if carry else [])])

    schema = StructType.fromDDL("doc_id long, text string, n_lines long, n_removed long, n_runs long, kept boolean")
    return through(d, StructType([*schema.fields, *d.schema.fields[3:]]), run)

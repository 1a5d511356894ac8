"""Packing documents into fixed windows: concatenate and cut.

Two passes. The first tokenises each document once, numbers the tokens of its partition from 0 and
writes ids and offsets. The second adds the tokens of all partitions before, prefix sums over one
row a partition, which gives every document its place in one endless sequence; window k is tokens
``k * window`` up to the next. A document that crosses a window's end is cut there, and its pieces
are the boundary records that join windows.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import materialise, rows_of, through

END_OF_TEXT = 1
#: Pattern by which byte-level BPE of this family cuts a text into words. Fixed value.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as long as this is left to ``tokenizers``: the other's matcher keeps a frame for each place it may go back to.
LONG_SPACE = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def load_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizer file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A byte-level BPE whose ids are its merge ranks runs in tiktoken, which gives the same ids as
    ``tokenizers`` about five times as fast; texts that hold one of the file's added tokens, which are
    one id each there, or a run of white space of ``LONG_SPACE`` characters, and any other file run in
    ``tokenizers``. A Python worker loads a file once, for all its tasks.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    byte_of = _byte_of()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    ranked = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
    if ranked and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab) == 256 + len(merges):
        import tiktoken

        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        plain = tiktoken.Encoding("own", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        space = re.compile(rf"\s{{{LONG_SPACE}}}")
        plainly = lambda text: not any(x in text for x in special) and (len(text) < LONG_SPACE or not space.search(text))
        return lambda text: plain(text) if plainly(text) else _in_tokenizers(path)(text)
    return _in_tokenizers(path)


@functools.lru_cache(maxsize=2)
def _in_tokenizers(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END_OF_TEXT, carry: list[str] = ()) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32 bits, ended by ``end``), ``n``, and the place in its partition: ``part, at``."""
    path = tokenizer or default_tokenizer()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = load_encoder(path), TaskContext.get().partitionId(), 0
        for batch in rows_of(batches):
            ids, n, start = [], [], []
            for text in batch.column(1):
                got = np.array([*encode(text.as_py()), end], "<u4")
                ids.append(got.tobytes())
                n.append(len(got))
                start.append(at)
                at += len(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(start, pa.int64())],
                names=["doc_id", "ids", "n", "part", "at"],
            )

    return through(d, "doc_id long, ids binary, n long, part int, at long", run)


def pack(docs: DataFrame, window: int = 2048, keep_ids: bool = True, **options) -> DataFrame:
    """Pieces of documents: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, padded``.

    Every id lies in one piece. All sequences are full but the last, whose ``padded`` length is ``window`` unless
    its own length is a power of two. Null and empty texts are the one end id. Rows with null or repeated
    ids are packed like others. No row of ``docs`` gives no piece.
    """
    tokens = materialise(tokenise(docs, **options), "pack-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("all"))
    # One row a partition of the first pass: its size is that of the job's own list of tasks.
    placed = tokens.join(F.broadcast(totals), F.col("part") == F.col("p")).select("doc_id", "ids", "n", (F.col("before") + F.col("at")).alias("place"), "all")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = []
            for doc, ids, n, place, everything in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = 0
                while start < n:
                    seq, off = divmod(place + start, window)
                    length = min(window - off, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    last = min(window, everything - seq * window)
                    padded = last if last & (last - 1) == 0 else window
                    out.append((doc, start, length, piece if keep_ids else b"", zlib.crc32(piece), n, seq, off, padded))
                    start += length
            names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
            cols = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return through(placed, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long", cut)


def sequences(pieces: DataFrame, window: int = 2048, pad: int = 0) -> DataFrame:
    """``sequence_id, ids`` (array, padded) of the pieces that ``pack`` made with their ids; a group is one window.

    Pieces come in any order and are put in that of their offsets; pieces without ids, or none at all, give no ids and no rows.
    Every document has one id at least, so there are no empty texts, ties or null offsets here; other columns are left out.
    """
    joined = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    packed = pieces.groupBy("sequence_id").agg(F.array_join(joined, "").alias("hex"), F.max("padded").alias("padded"))
    number = lambda i: F.conv(F.concat(*[F.substring("hex", i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    ids = F.transform(F.sequence(F.lit(0), (F.length("hex") / 8).cast("int") - 1), number)
    fill = F.array_repeat(F.lit(pad), (F.col("padded") - F.length("hex") / 8).cast("int"))
    return packed.select("sequence_id", F.concat(ids, fill).alias("ids"))
